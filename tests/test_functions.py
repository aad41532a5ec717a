"""Scalar functions on small tables of values."""

import random

import pytest
from pyspark.sql import functions as F

from weftwork import config as C
from weftwork.functions import fuzzy as Z
from weftwork.functions import normalize as N
from weftwork.functions import text as X
from weftwork.operators import resume, score, validate


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def table(spark, function, cases, kind="string"):
    assert values(spark, function, list(cases), kind) == list(cases.values())


def test_phone(spark):
    table(spark, N.phone, {"9876543210": "+919876543210", "+91 98765-43210": "+919876543210", "(+91)9876543210": "+919876543210", "098765 43210": "+919876543210", "123": "123", "not-a-phone": "not-a-phone", "+1-800-555-0199": "+18005550199", "": "", None: None, " 12 ": "12"})
    assert values(spark, lambda c: N.phone(c, "US"), ["800 555 0199", "1 800 555 0199"]) == ["+18005550199", "+18005550199"]


def test_date(spark):
    table(spark, N.date, {"Jan 2022": "2022-01", "January 2022": "2022-01", "01/2022": "2022-01", "2022-01": "2022-01", "2022": "2022", "present": None, "Ongoing": None, "01-2022": "2022-01", "Sept 2021": "2021-09", "3 March 2020": "2020-03", "March 3, 2020": "2020-03", "never": "never", "": "", None: None, " soon ": "soon"})


def test_name(spark):
    table(spark, N.name, {"jan VAN der berg": "Jan van der Berg", "  john   smith ": "John Smith", "JOHN a. SMITH": "John A. Smith", "o'BRIEN mc-donald": "O'brien Mc-donald", "van halen": "Van Halen", "ﬁona": "Fiona", "élise": "Élise", " ": " ", "": "", None: None})


def test_email_url(spark):
    table(spark, N.email, {" A@B.Com ": "a@b.com", "odd": "odd", "": "", None: None})
    table(spark, N.url, {"Example.com/A/": "https://example.com/A", "http://X.com": "http://x.com/", "HTTP://x.com/a": "https://http://x.com/a", "https://x.com/a/?b=C/": "https://x.com/a?b=C/", None: None, " ": " "})
    table(spark, X.url_key, {"https://www.A.com/b/": "a.com/b", "a.com/b": "a.com/b"})
    table(spark, X.site, {"https://GitHub.com/x": "GitHub", "https://x.dev": "Website", "https://notgithub.com/x": "Website", "github.com/a": "GitHub"})


@pytest.mark.parametrize("normalize", [N.email, N.name, N.phone, N.url, N.date])
def test_normalizers_are_idempotent(spark, normalize):
    raw = [" Jan 2020 ", "A@B.C", "9876543210", "x.com/Y/", "ANN de la CRUZ", "", None, "+44 20 7946 0958", "2020-13", "Present"]
    once = values(spark, normalize, raw)
    assert values(spark, normalize, once) == once


def test_degree(spark):
    table(spark, N.degree, {"B.E": "bachelor of engineering", "B.E.": "bachelor of engineering", "B.E in Computer Science": "bachelor of engineering", "M.S.": "master of science", None: "", "Diploma (Hons)": "diploma", "Ph.D": "doctor of philosophy"})


def test_forms(spark):
    table(spark, N.location, {"Bengaluru, India": "bangalore india", "NYC": "new york city", "São Paulo!": "são paulo"})
    table(spark, N.phone_digits, {"01234567890": "1234567890", "0123": "0123", "+91 98765-43210": "919876543210"})


def test_contacts(spark):
    table(spark, X.email, {"mail me: A.b@C.io now": "A.b@C.io", "none": None})
    table(spark, X.phone, {"call +91 98765-43210 or 12": "+91 98765-43210", "2019": None, "x 123-4567": "123-4567"})
    table(spark, X.person_name, {"Resume 2024\nx@y.z\nAda M. Lovelace\nBob B": "Ada M. Lovelace", "Single": None, "+91 9999999999\nAnn Lee": "Ann Lee"})


def test_cells(spark):
    table(spark, X.cell_list, {"a, b;c|d\n e": ["a", "b", "c", "d", "e"], '["x", " y "]': ["x", "y"], "[broken": ["[broken"], " ": [], None: []})


def test_links(spark):
    found = values(spark, lambda c: F.transform(X.text_links(c), lambda x: F.concat(x["label"], F.lit(" "), x["url"])), ["see https://www.linkedin.com/in/ada, github.com/ada and https://ada.dev/x."])[0]
    assert found == ["LinkedIn https://www.linkedin.com/in/ada", "GitHub https://github.com/ada", "Website https://ada.dev/x"]
    kind = "array<struct<url:string,label:string>>"
    links = [[("https://a.com/", "Website"), ("http://www.a.com", "Other"), ("https://github.com/x", "GitHub"), ("https://github.com/y", "github"), ("https://b.com", "Website"), ("c.com", None)]]
    assert [x.url for x in values(spark, X.merge_links, links, kind)[0]] == ["https://a.com/", "https://github.com/x", "https://b.com", "c.com"]


def test_skills(spark):
    table(spark, X.skill, {" node  js. ": "Node.js", "c++": "C++", "Cobol": "Cobol"})
    assert values(spark, X.tidy_skills, [["python", "Python", "", "SQL"]], "array<string>") == [["Python", "SQL"]]
    assert values(spark, X.tech_terms, ["I use C++, not c# or Java.", "javascript"]) == [["C++", "C#"], ["JavaScript"]]
    groups = C.STANDARD_SYNONYMS
    assert values(spark, lambda c: N.skills(c, groups), [["ML", "machine learning", "JS", "Javascript", "Data Bases", "Data Base", "AWS"]], "array<string>") == [["Machine Learning", "JavaScript", "Data Bases", "Amazon Web Services"]]
    assert values(spark, lambda c: N.skill_synonyms(c, groups), [["ML", "ml", "Go"]], "array<string>") == [["Machine Learning", "Go"]]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_lcs_kernels_agree(spark):
    rng = random.Random(0)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", Z.ratio(F.col("a"), F.col("b")).alias("x"), Z.ratio_udf("a", "b").alias("y")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got):
        want = 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
        assert Z.lcs_length(a, b) == lcs(a, b)
        assert r.x == pytest.approx(want) and r.y == pytest.approx(want)


def test_partial_ratio():
    assert Z.plain_partial("ai/ml intern", "ai/ml intern (virtual internship 6.0)") == 1.0
    assert Z.plain_partial("abc", "xxabcx") == 1.0 and Z.plain_partial("abc", "zzz") == 0.0
    assert Z.plain_token_sort("Smith John", "John Smith") == 1.0 and Z.plain_token_sort(None, "x") == 0.0


def test_scores(spark):
    def noisy(ws):
        return spark.createDataFrame([(float(w),) for w in ws], "w double").agg(score.noisy_or(F.col("w")).alias("x")).first().x

    assert noisy([0.9, 0.8]) == pytest.approx(0.98) and noisy([0.75]) == pytest.approx(0.75) and noisy([]) == 0 and noisy([1, 1]) == 1
    curve = values(spark, lambda c: score.agreement_curve(c, 0.95, 0.80, 0.05, 0.10), [1.0, 0.95, 0.80, 0.4, 0.0], "double")
    assert curve == [pytest.approx(x) for x in (0.05, 0.0475, 0.0, -0.05, -0.10)]
    conf = C.Confidence()

    def alike(field, a, b):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        return df.select(score.similarity(field, score.form(field, F.col("a"), conf), score.form(field, F.col("b"), conf)).alias("s")).first().s

    assert alike("email", "A@b.c", "a@B.C ") == 1 and alike("email", "a@b.c", "x@b.c") == 0
    assert alike("phone", "+91 98765 43210", "9876543210") == 0.95
    assert alike("location", "Bengaluru", "Bangalore") == 1 and alike("location", "Hyderabad", "Hyderabad, India") == 0.9
    assert alike("name", "Ann Lee", "Ann Li") == pytest.approx(10 / 13)


def test_python_repr(spark):
    table(spark, validate.python_repr, {x: repr(x) for x in ["a", "it's", 'say "x"', "both ' and \"", "a\\b", "line\nbreak"]} | {None: "None"})


def test_sections(spark):
    text = "Ada L\n\nWORK EXPERIENCE:\nA\n- Education -\nB\n\nSkills\nold\nAchievements\nC\nSkills\nnew"
    out = values(spark, lambda c: F.transform(resume.sections(c), lambda s: F.concat_ws("=", s["name"], s["content"])), [text, "no headings"])
    assert out[0] == ["_header=Ada L", "experience=A", "education=B", "skills=old", "achievements=C", "skills=new"]
    assert out[1] == ["_header=no headings"]
    assert values(spark, lambda c: resume.section(resume.sections(c), "skills"), [text]) == ["new"]


def test_experience(spark):
    text = "Intern\nInfosys\nJun 2024 – Aug 2024\n• Built ML models\nmore\n\nAcme Corp\nSenior Engineer\n2020 - 2024\n\nJan 2022 - Present"
    jobs = values(spark, resume.experience, [text, ""], None or "string")
    a, b, c = jobs[0]
    assert (a.title, a.company, a.description, a.duration.start, a.duration.end, a.duration.is_current) == ("Intern", "Infosys", "• Built ML models more", "Jun 2024", "Aug 2024", False)
    assert (b.title, b.company, b.duration.start, b.duration.end, b.duration.is_current) == ("Senior Engineer", "Acme Corp", "2020", None, True)
    assert c.title == "Jan 2022 - Present" and c.duration.start == "Jan 2022"
    assert jobs[1] == []


def test_education(spark):
    text = "B.E in Computer Science\n2018 - 2022\n\nSome University\nCGPA: 8.5/10\n\nHigh School\n2016 – present\n\n2015"
    one, two = values(spark, resume.education, [text])[0]
    assert (one.degree, one.institution, one.duration.start, one.duration.end, one.gpa) == ("B.E in Computer Science", "Some University", "2018", "2022", 8.5)
    assert (two.institution, two.degree, two.duration.start, two.duration.end) == ("High School", None, "2016", None)


def test_education_year_of_a_date_line(spark):
    """A number in the institution's name is no start beside a date line; without one the first year anywhere is."""
    texts = ["Uni 1999\nB.E in Physics\n2018", "Uni 1999\nB.E in Physics\nGPA: 8\n12345\nJune 2018\n2020", "Uni 1999\nB.E in Physics\n2018 – present", "MIT, 2014\nB.E in Physics", "B.E in Physics\n2018\n\nUni 1999", "Uni 1999\nB.E in Physics\n1850"]
    out = [(x[0].institution, x[0].duration.start, x[0].duration.end) for x in values(spark, resume.education, texts)]
    assert out == [("Uni 1999", "2018", None), ("Uni 1999", "2018", None), ("Uni 1999", "2018", None), ("MIT, 2014", "2014", None), ("Uni 1999", "2018", None), ("Uni 1999", "1999", None)]


def test_skill_sections(spark):
    read = lambda c: resume.skills(resume.section(resume.sections(c), "skills"), c)
    text = "Experience\nx\nTechnical Skills and Coursework\nLanguages: Python, Go / cpp\n• Rust; x | Kotlin\nFrameworks\nProjects\nFlask"
    assert values(spark, read, [text, "Skills\noracle, Go, A1, B2, C3"]) == [["Python", "Go", "C++", "Rust", "Kotlin"], ["racle", "Go", "A1", "B2", "C3"]]


def test_year_month_equals_the_layouts(spark):
    """Against Spark's own parser, layout by layout, on capitalised text."""
    layouts = ["yyyy-M", "yyyy-M-d", "yyyy/M", "yyyy/M/d", "M/yyyy", "M-yyyy", "MMM yyyy", "MMMM yyyy", "M/d/yyyy", "M-d-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy"]
    texts = ["2020-05", "2020-5", "2020-13", "2020-00", "2020/05", "2020/5/7", "2020-02-30", "2020-02-29", "2021/02-03", "2021-2/3", "5/2020", "05-2020", "13/2020", "May 2020", "Mai 2020", "June 2020", "Jun 2020", "Sep 2020", "Septe 2020", "2/29/2021", "2/28/2021", "12-31-1999", "31-12-1999", "7 May 2020", "07 June 2020", "31 Jun 2020", "May 7 2020", "May 2020 7", "December 31 2020", "2020", "", "x", "20-05-2020", "2020-05-07T00", "99 May 2020", "May 99 2020", "0 May 2020", "1/1/0999"]
    read = F.coalesce(*[F.date_format(F.try_to_timestamp("t", F.lit(x)), "yyyy-MM") for x in layouts])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.year_month(F.col("t")).alias("got"), read.alias("want")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]
