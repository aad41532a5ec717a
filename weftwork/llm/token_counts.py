r"""Token counts by trie-shared dynamic programming.

A text's pre-tokens (a blank and the characters up to the next one; line breaks alone) are inserted in a trie. The unigram
forward score of a prefix - the best sum of piece scores over its segmentations - depends on the prefix
alone, so it is computed once for each trie node, from the nodes above it, and shared by all words that
begin so. A word's terminal count is the number of pieces on the best path; a text's count is the sum over
its words.

Pieces are those of a public SentencePiece file (its path is a parameter; blanks are kept, and a first blank is put before
the text). A unigram file's scores are log probabilities and taken as they are. The scores of a file of merges are only
ranks, whose sums mean nothing, so a piece of rank r among n has the log probability of Zipf's law, -ln(r H_n). Characters outside the vocabulary stand alone and count as their
UTF-8 bytes. Of equal scores, the path whose last piece is longest wins.

Scale: one narrow pass, no shuffle: each Python worker keeps a trie and terminal counts bounded by ``max_nodes`` and
``max_words``, inside one text too, and starts that one anew beyond its bound; results do not depend on it. Words longer
than ``depth`` characters share their first ones; the rest is scored in a window of the longest piece and not kept.

Defined results: null and empty texts have 0 pre-tokens and 0 tokens; repeated rows are rows of their
own; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MAX_NODES, MAX_WORDS, DEPTH, LONG_TEXT = 600_000, 1_200_000, 64, 1 << 20
BLANK = "▁"


def zipf(scores: dict[str, float]) -> dict[str, float]:
    """Log probabilities of pieces known by order of score alone: 1 / (r H_n) for rank r of n; equals share the last rank."""
    order, total = sorted(-s for s in scores.values()), sum(1 / r for r in range(1, len(scores) + 1))
    return {w: -math.log(bisect.bisect_right(order, -s) * total) for w, s in scores.items()}


def pieces(path: str) -> dict[str, float]:
    """Normal pieces of a SentencePiece file and their log probabilities."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {p.id_to_piece(i): p.get_score(i) for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
    # a file of merges numbers its pieces downwards from 0
    return zipf(scores) if all(s <= 0 and s == int(s) for s in scores.values()) else scores


class Trie:
    """Node 0 is the root; next maps node * 2**21 + code point to a node; best and count hold its forward score and pieces."""

    def __init__(self, vocabulary: dict[str, float], max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS):
        self.score, self.longest = vocabulary, max(map(len, vocabulary), default=1)
        self.alphabet = frozenset(c for w in vocabulary for c in w)
        self.max_nodes, self.max_words = max_nodes, max_words
        # no piece crosses a line break or tab that no piece holds, so these stand alone
        alone = "".join(c for c in "\n\r\t" if c not in self.alphabet)
        self.word = re.compile(f" ?[^ {alone}]+|[ {alone}]")
        self.next, self.best, self.count, self.words = {}, [0.0], [0], {}

    def _span(self, s: str) -> int:
        """Pieces of s, all of whose characters are single pieces or part of one."""
        if len(self.best) > self.max_nodes:
            self.next, self.best, self.count = {}, [0.0], [0]
        nxt, best, count, score, longest = self.next, self.best, self.count, self.score, self.longest
        node, path = 0, [0]
        for j, c in enumerate(s[:DEPTH], 1):
            key = node << 21 | ord(c)
            node = nxt.get(key)
            if node is None:
                top, pieces = float("-inf"), 0
                for i in range(max(0, j - longest), j):
                    if (v := score.get(s[i:j])) is not None and (total := best[path[i]] + v) > top:
                        top, pieces = total, count[path[i]] + 1
                node = nxt[key] = len(best)
                best.append(top)
                count.append(pieces)
            path.append(node)
        end = best[node], count[node]
        if len(s) > DEPTH:
            end = self._rest(s, [(best[n], count[n]) for n in path[-longest:]])
        if end[0] == float("-inf"):  # no segmentation: characters one by one
            return sum(1 if c in score else len(c.encode()) for c in s)
        return end[1]

    def _rest(self, s: str, last: list[tuple[float, int]]) -> tuple[float, int]:
        """Forward score and pieces of a long word, from those of its first DEPTH characters; the last few are kept."""
        score, longest = self.score, self.longest
        for j in range(DEPTH + 1, len(s) + 1):
            top, pieces = float("-inf"), 0
            first = j - len(last)
            for i, (b, n) in enumerate(last, first):
                if (v := score.get(s[i:j])) is not None and b + v > top:
                    top, pieces = b + v, n + 1
            last.append((top, pieces))
            if len(last) > longest:
                del last[0]
        return last[-1]

    def insert(self, word: str) -> int:
        """Terminal count of a pre-token."""
        if self.alphabet.issuperset(word):
            return self._span(word)
        total, run = 0, []
        for c in word:
            if c in self.alphabet:
                run.append(c)
            else:  # outside the vocabulary: no piece crosses it
                if run:
                    total += self._span("".join(run))
                    run = []
                total += len(c.encode())
        return total + (self._span("".join(run)) if run else 0)

    def word_count(self, w: str) -> int:
        """Terminal count of a pre-token as it stands in a text; kept unless it is very long."""
        known = self.words.get(w)
        if known is None:
            known = self.insert(BLANK + w[1:] if w[0] == " " else w)
            if len(w) <= DEPTH:
                if len(self.words) >= self.max_words:
                    self.words = {}
                self.words[w] = known
        return known

    def text(self, text: str | None) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        if not text:
            return 0, 0
        if len(text) > LONG_TEXT:  # one word at a time
            n = total = 0
            for m in self.word.finditer(" " + text):
                n, total = n + 1, total + self.word_count(m[0])
            return n, total
        words = self.word.findall(" " + text)
        try:
            return len(words), sum(map(self.words.__getitem__, words))
        except KeyError:
            for w in set(words).difference(self.words):
                self.word_count(w)
            return len(words), sum(map(self.word_count, words))


_tries: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    """One for each Python worker."""
    if path not in _tries:
        _tries[path] = Trie(pieces(path))
    return _tries[path]


def token_counts(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_pretokens and n_tokens of each row."""

    def run(batches):
        own = trie(path)
        for batch in batches:
            rows = [own.text(x.as_py()) for x in batch.column(1)]
            a, b = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[key, "n_pretokens", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_pretokens long, n_tokens long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
