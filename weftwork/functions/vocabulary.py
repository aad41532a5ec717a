"""Word lists, patterns and constants of the record model."""

# They must equal these for right results.

SCALARS = ["name", "email", "phone", "location", "summary"]
LISTS = ["skills", "experience", "education", "links"]

FIELD_ALIASES = {
    "name": ["name", "full_name", "fullname", "candidate_name", "candidatename", "applicant_name", "first_last", "person_name"],
    "email": ["email", "email_address", "emailaddress", "e-mail", "mail", "contact_email", "work_email", "primary_email"],
    "phone": ["phone", "phone_number", "phonenumber", "mobile", "mobile_number", "contact", "contact_number", "telephone", "cell", "mobile_no", "phone_no"],
    "location": ["location", "city", "state", "country", "address", "current_location", "place", "residence", "city_state", "city_country", "current_city", "current_address", "hometown", "native_place"],
    "summary": ["summary", "bio", "about", "profile", "objective", "about_me", "professional_summary", "overview", "professional_profile", "career_objective", "career_summary"],
    "skills": ["skills", "skill", "technologies", "tech_stack", "expertise", "competencies", "tools", "languages", "technical_skills", "core_skills", "key_skills", "programming_languages", "frameworks", "libraries", "technical_expertise", "tech_skills", "core_competencies", "technical_competencies"],
    "linkedin": ["linkedin", "linkedin_url", "linkedin_profile", "linkedin_link"],
    "github": ["github", "github_url", "github_profile", "github_link"],
    "portfolio": ["portfolio", "website", "personal_website", "portfolio_url"],
    "experience": ["experience", "work_experience", "employment", "work_history"],
    "education": ["education", "academic", "academics", "qualification", "qualifications"],
}

NAME_PARTICLES = ["van", "de", "der", "den", "von", "del", "della", "di", "da", "la", "le", "al"]

DEGREES = {
    "be": "bachelor of engineering", "btech": "bachelor of technology", "bsc": "bachelor of science", "bcom": "bachelor of commerce", "ba": "bachelor of arts",
    "mtech": "master of technology", "me": "master of engineering", "ms": "master of science", "msc": "master of science", "mba": "master of business administration",
    "phd": "doctor of philosophy", "mca": "master of computer applications", "bca": "bachelor of computer applications",
}

LOCATION_ALIASES = {
    "bengaluru": "bangalore", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "nyc": "new york city",
    "ny": "new york", "la": "los angeles", "sf": "san francisco", "dc": "washington dc", "uk": "united kingdom",
}

SKILL_ALIASES = {
    "python": "Python", "node.js": "Node.js", "nodejs": "Node.js", "node js": "Node.js",
    "react js": "React.js", "reactjs": "React.js", "react.js": "React.js", "react": "React",
    "c sharp": "C#", "csharp": "C#", "c#": "C#", "cpp": "C++", "c plus plus": "C++", "c++": "C++",
    "machine learning": "Machine Learning", "ml": "Machine Learning", "deep learning": "Deep Learning", "dl": "Deep Learning",
    "javascript": "JavaScript", "js": "JavaScript", "typescript": "TypeScript", "ts": "TypeScript",
    "html5": "HTML", "html": "HTML", "css3": "CSS", "css": "CSS", "sql": "SQL", "postgresql": "PostgreSQL", "postgres": "PostgreSQL",
    "mongodb": "MongoDB", "mysql": "MySQL", "aws": "AWS", "gcp": "GCP", "azure": "Azure", "docker": "Docker",
    "kubernetes": "Kubernetes", "k8s": "Kubernetes", "git": "Git", "github": "GitHub", "tensorflow": "TensorFlow", "pytorch": "PyTorch",
    "numpy": "NumPy", "pandas": "Pandas", "oop": "OOP", "dbms": "DBMS",
}

TECH_TERMS = [
    "Python", "Java", "C", "C++", "C#", "JavaScript", "TypeScript", "Go", "Rust", "Kotlin", "Swift",
    "React", "Angular", "Vue", "Next.js", "HTML", "CSS", "Bootstrap", "Tailwind",
    "Node.js", "Express", "FastAPI", "Flask", "Django", "Spring Boot", "ASP.NET MVC",
    "TensorFlow", "PyTorch", "Scikit-learn", "Keras", "OpenCV", "NumPy", "Pandas",
    "Matplotlib", "Seaborn", "XGBoost", "LightGBM",
    "MongoDB", "MySQL", "PostgreSQL", "SQLite", "Redis", "Oracle",
    "AWS", "Azure", "GCP", "Docker", "Kubernetes", "Jenkins",
    "Git", "GitHub", "VS Code", "Visual Studio", "Linux",
    "OOP", "DBMS", "Operating Systems", "Computer Networks", "Algorithms", "System Design",
]

LINK_SITES = {"LinkedIn": "linkedin", "GitHub": "github", "LeetCode": "leetcode", "CodeChef": "codechef", "HackerRank": "hackerrank", "Kaggle": "kaggle", "Medium": "medium", "StackOverflow": "stackoverflow"}

#: Columns that hold one link, by label; csv and json spell some of them differently.
LINK_COLUMNS = {
    "csv": {
        "LinkedIn": ["linkedin", "linkedin_url", "linkedin_profile", "linkedin_link"], "GitHub": ["github", "github_url", "github_profile", "github_link"],
        "Portfolio": ["portfolio", "portfolio_url", "portfolio_link"], "Website": ["website", "personal_website", "personal_site"],
        "LeetCode": ["leetcode", "leetcode_url", "leetcode_profile"], "CodeChef": ["codechef", "codechef_url", "codechef_profile"],
        "HackerRank": ["hackerrank", "hackerrank_url", "hackerrank_profile"], "Kaggle": ["kaggle", "kaggle_url", "kaggle_profile"],
        "Medium": ["medium", "medium_url", "medium_profile"], "StackOverflow": ["stackoverflow", "stackoverflow_url", "stackoverflow_profile"],
    },
    "json": {
        "LinkedIn": ["linkedin", "linkedin_url", "linkedin_profile"], "GitHub": ["github", "github_url", "github_profile"],
        "Portfolio": ["portfolio", "portfolio_url"], "Website": ["website", "personal_website", "personal_site"],
        "LeetCode": ["leetcode", "leetcode_url", "leetcode_profile"], "CodeChef": ["codechef", "codechef_url", "codechef_profile"],
        "HackerRank": ["hackerrank", "hackerrank_url", "hackerrank_profile"], "Kaggle": ["kaggle", "kaggle_url", "kaggle_profile"],
        "Medium": ["medium", "medium_url", "medium_profile"], "StackOverflow": ["stackoverflow", "stackoverflow_url", "stackoverflow_profile"],
    },
}

USERNAME_COLUMNS = {
    "github_username": ("https://github.com/", "GitHub"), "github_handle": ("https://github.com/", "GitHub"),
    "linkedin_username": ("https://linkedin.com/in/", "LinkedIn"), "linkedin_handle": ("https://linkedin.com/in/", "LinkedIn"),
    "leetcode_username": ("https://leetcode.com/", "LeetCode"), "leetcode_handle": ("https://leetcode.com/", "LeetCode"),
    "codechef_username": ("https://codechef.com/users/", "CodeChef"), "hackerrank_username": ("https://hackerrank.com/profile/", "HackerRank"),
    "kaggle_username": ("https://kaggle.com/", "Kaggle"), "medium_username": ("https://medium.com/@", "Medium"),
}

CSV_COLUMNS = {
    "company": ["company", "employer", "organization", "organisation", "current_company", "previous_company", "last_company"],
    "title": ["role", "position", "designation", "job_title", "current_role", "current_position", "current_designation", "last_role", "last_designation"],
    "exp_start": ["start_date", "from_date", "joining_date", "date_of_joining", "employment_start"],
    "exp_end": ["end_date", "to_date", "relieving_date", "date_of_leaving", "employment_end"],
    "description": ["responsibilities", "job_description", "work_description", "work_summary", "role_description", "duties"],
    "exp_type": ["employment_type", "job_type", "work_type", "type_of_employment"],
    "exp_location": ["job_location", "work_location", "office_location"],
    "institution": ["college", "university", "institute", "school", "institution", "alma_mater", "college_name", "university_name"],
    "degree": ["degree", "qualification", "course", "degree_name", "program"],
    "field": ["major", "specialization", "specialisation", "branch", "field_of_study", "stream", "subject"],
    "gpa": ["cgpa", "gpa", "percentage", "grade", "marks", "score"],
    "edu_end": ["graduation_year", "passing_year", "end_year", "year_of_passing", "year_of_graduation", "batch", "passout_year"],
    "edu_start": ["start_year", "admission_year", "year_of_admission", "joining_year"],
    "projects": ["project", "projects", "project_name", "project_names", "project_title", "project_titles", "project_details"],
    "certifications": ["certification", "certifications", "certificate", "certificates", "credential", "credentials", "course_certification", "training", "courses"],
    "achievements": ["achievements", "achievement", "awards", "honors", "honours", "recognition", "accomplishments", "accolades"],
    "languages": ["languages_known", "known_languages", "spoken_languages", "language_proficiency", "language_skills", "languages_spoken", "language"],
}
MISC = ["projects", "certifications", "achievements", "languages"]

JSON_WRAPPERS = ["candidate", "profile", "applicant", "person", "data", "record", "resume"]
JSON_KEYS = {
    "experience": ["experience", "work_experience", "employment", "employment_history", "work_history"],
    "education": ["education", "academics", "qualifications", "academic", "qualification"],
    "skills": ["skills", "skill", "technical_skills", "core_skills", "technology_stack", "technologies", "tech_stack"],
    "projects": ["projects", "personal_projects", "project"],
    "certifications": ["certifications", "certificates", "certification", "certificate", "credentials", "courses", "training"],
    "achievements": ["achievements", "achievement", "awards", "honors", "honours", "accomplishments"],
    "languages": ["languages", "languages_known", "spoken_languages", "language"],
    "links": ["links", "social_links", "social_profiles", "profiles"],
    "root": ["name", "full_name", "fullname", "candidate_name", "applicant_name", "email", "email_address", "emailaddress", "e_mail", "mail", "phone", "phone_number", "mobile", "mobile_number", "telephone", "location", "city", "address", "current_location"],
}
#: Keys of a list item, the first one with a value wins.
JSON_ITEM = {
    "company": ["company", "organization", "employer"],
    "title": ["title", "role", "position", "designation"],
    "description": ["description", "summary", "responsibilities", "details"],
    "exp_start": ["start", "start_date", "from", "from_date"],
    "exp_end": ["end", "end_date", "to", "to_date"],
    "institution": ["institution", "university", "school", "college", "alma_mater", "institute"],
    "degree": ["degree", "qualification", "program", "course"],
    "field": ["field", "field_of_study", "major", "specialization", "specialisation", "branch", "stream"],
    "edu_start": ["start_year", "admission_year", "joining_year", "from_year"],
    "edu_end": ["end_year", "graduation_year", "passing_year", "year_of_passing", "year_of_graduation", "year"],
    "gpa": ["cgpa", "gpa", "percentage", "grade", "marks", "score"],
}

SECTIONS = {
    "experience": r"(?:work\s+|professional\s+)?experience|employment(?:\s+history)?|work\s+history",
    "education": r"education(?:al?\s+background)?|academic(?:s|(?:\s+background))?",
    "skills": r"(?:technical\s+)?skills?|technologies|competenc(?:y|ies)|expertise",
    "summary": r"(?:professional\s+)?summary|profile|objective|about(?:\s+me)?",
    "projects": r"projects?|personal\s+projects?",
    "certifications": r"certifications?|certificates?|licenses?",
    "achievements": r"achievements?|awards?|honors?|honours?|accolades?|accomplishments?|recognition",
    "leadership": r"positions?\s+of\s+responsibility|leadership(?:\s+(?:roles?|experience))?|extracurricular(?:\s+activities?)?",
    "other": r"publications?|references?|interests?|hobbies|volunteer(?:ing)?|activities",
}
SKILL_HEADINGS = [
    "skills", "skill", "technical skills", "technical skill", "technical skills and coursework", "technical skills & coursework", "technical expertise",
    "core skills", "professional skills", "technical competencies", "competencies", "core competencies", "professional competencies",
    "areas of expertise", "expertise", "technology stack", "tech stack", "tools", "technologies", "programming languages", "programming skills",
    "languages & technologies", "languages and technologies", "software skills", "software proficiency", "development skills", "engineering skills",
    "technical proficiencies", "key skills", "primary skills", "skills summary", "relevant skills", "relevant technologies", "technology summary",
    "technical knowledge", "knowledge areas", "technology experience", "languages", "frameworks", "libraries", "developer tools", "tool stack",
]
OTHER_HEADINGS = [
    "experience", "work experience", "professional experience", "work history", "employment", "employment history",
    "education", "educational background", "academic background", "academics", "projects", "personal projects",
    "certifications", "certificates", "licenses", "summary", "professional summary", "profile", "objective", "about", "about me",
    "awards", "achievements", "achievement", "honors", "honours", "accolades", "accomplishments", "recognition",
    "publications", "interests", "references", "volunteer", "volunteering", "extracurricular activities", "activities",
    "hobbies", "languages spoken", "position of responsibility", "positions of responsibility", "leadership", "leadership roles", "leadership experience",
]
NOISE_LABELS = [
    "programming languages", "frameworks", "libraries", "databases", "developer tools", "machine learning", "cloud", "tools", "technologies",
    "frontend", "backend", "devops", "languages", "tool stack", "core cs", "ai/ml", "ai", "ml",
]

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
LOOSE_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"(?:\+?\d{1,3}[\s\-.]?)?(?:\(?\d{2,4}\)?[\s\-.]?)?\d{3,5}[\s\-.]?\d{3,5}(?:[\s\-.]?\d{1,4})?"
MONTHS = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
MONTH_YEAR = rf"{MONTHS}[\s,]+\d{{4}}"
NUMBER_YEAR = r"(?:0?[1-9]|1[0-2])[/\-]\d{4}"
PRESENT = r"present|current|now|ongoing"
#: The dash belongs to the first alternative of the tail only.
DATE = rf"(?:{MONTH_YEAR}|{NUMBER_YEAR}|\d{{4}})(?:\s*[-–—]\s*{MONTH_YEAR}|{NUMBER_YEAR}|{PRESENT}|\d{{4}})?"
DATE_TAIL = rf"^\s*[-–—]\s*(?:{PRESENT}|(?:19|20)\d{{2}})\s*$"
YEAR_RANGE = rf"\b((?:19|20)\d{{2}})\s*[-–—]\s*((?:19|20)\d{{2}}|{PRESENT})\b"
ONE_YEAR = r"\b((?:19|20)\d{2})\b"
CANONICAL_DATE = r"^\d{4}(?:-(?:0[1-9]|1[0-2]))?$"
MARKER = r"^[\s•▪◦‣➜o\*\-]+"
EXPERIENCE_LABEL = r"^(?:role|title|position|designation|company|organization|employer|duration)\s*:\s*"
JOB_TITLE = (
    r"\b(?:intern|engineer|developer|analyst|manager|lead|architect|consultant|associate|junior|senior|designer|scientist|researcher|officer|specialist|"
    r"director|head|coordinator|executive|trainee|apprentice|programmer|technician|administrator|assistant)\b"
)
DEGREE_LINE = r"^(?:B\.?Tech|B\.?E\.?|M\.?Tech|M\.?E\.?|M\.?S(?:c)?|B\.?Sc|B\.?Com|B\.?A|MBA|Ph\.?D|MCA|BCA|Bachelor|Master|Diploma|Associate)\b"
GPA_LINE = r"\b(?:cgpa|gpa|percentage|grade|marks|score)\b"
NAME_SKIP = r"@|http|www\.|linkedin|github|^\+?\d[\d\s\-().]{6,}$|^\d{10}$"
SELF_EMPLOYED = r"\b(freelance[rd]?|self[‑\-\s]employed|consultant|founder|co[‑\-\s]founder|independent\s+contractor|contract(?:or)?)\b"
GENERIC_URL = r"https?://[^\s()<>\"']+"
GENERIC_LABELS = ["website", "other", ""]

REQUIRED_MESSAGES = {"name": "Candidate name is required", "email": "Candidate email is required"}
FIELD_LABELS = {
    "name": "Candidate name", "email": "Email address", "phone": "Phone number", "skills": "Skills list", "experience": "Work experience",
    "education": "Education history", "links": "Professional links (LinkedIn/GitHub/Portfolio)", "summary": "Professional summary", "location": "Location",
}
