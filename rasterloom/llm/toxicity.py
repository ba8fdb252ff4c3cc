"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding: compatibility forms, lower case, accents off, look-alike letters of other scripts to Latin ones, digits and
signs to letters in words that hold a letter, anything else to one space. Entries are beginnings of words.

The lexicon is learned from labelled rows: at most `fit_toxic` toxic and `fit_clean` clean ones, those of least id
hash. An entry is a beginning of `least_chars` characters or more that at least `least_rows` toxic rows, and a share of
`least_share` of them, show, each between words of its own (so a much copied text counts once), and clean ones rarely; its weight is the log of the ratio of
the shares of rows that have it. Exception phrases are an entry's word with the word before or after it, where clean
rows show that pair and toxic ones don't; a match that is part of one doesn't count. The sum of the weights over the
text's words is turned into a score by a logistic curve fitted to the same rows.

Defined cases: null and empty texts score as a text without a match; without labels of both kinds the lexicon is
empty and every score 0; labels that are null don't count, and a row with several counts as toxic if one says so; of
documents that share an id the least text is learned from;
texts are matched whole; repeated rows score alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and what is written for letters.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁԛαβεικνορτυχɡıɪᴏ",
    "abekmhopctyxijsdqabeikvoptuxgiio",
)
DIGITS = str.maketrans("0345789@$!", "oeastbgasi")
ONE = str.maketrans("1|", "ii"), str.maketrans("1|", "ll")  # either letter may be meant
ZERO_WIDTH = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])

_ACCENTS = re.compile(r"[\u0300-\u036f]+")
_MIXED = re.compile(r"[a-z0-9@$!|]*[a-z][a-z0-9@$!|]*")


def fold(text: str) -> str:
    """The folded words, each behind a space, and a space at the end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(ZERO_WIDTH)).casefold().translate(LOOKALIKES)
        text = _ACCENTS.sub("", text)
    else:
        text = text.lower()
    words = []
    for w in text.split():
        w = w.strip(".,;:!?\"'()[]{}*_-")
        if w.isalpha():
            words.append(w)
        elif m := _MIXED.fullmatch(w):
            words += dict.fromkeys(m[0].translate(DIGITS).translate(one) for one in ONE)
        else:
            words += [x.translate(DIGITS) for x in re.split(r"[^\w@$!|]+|_+", w) if x and not x.isdigit()]
    return " " + " ".join(words) + " "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope: float = 0.0
    offset: float = -math.inf

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(" " + entry, (len(entry) + 1, w))
        if self.weights:
            a.make_automaton()
        return a

    def density(self, folded: str, automaton) -> float:
        """Weight a hundred words; a short text counts as ten words."""
        if not self.weights:
            return 0.0
        best: dict[int, float] = {}
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            best[start] = max(best.get(start, 0.0), w)  # one match for each word
        if not best:
            return 0.0
        total = sum(w for at, w in best.items() if not (self.exceptions and self._excused(folded, at)))
        return 100 * total / max(10, folded.count(" ") - 1)

    def _excused(self, folded: str, at: int) -> bool:
        """Whether the word behind the space at `at` is part of an exception phrase."""
        end = folded.index(" ", at + 1)
        word = folded[at + 1 : end]
        before = folded[folded.rfind(" ", 0, at) + 1 : at] if at else ""
        after = folded[end + 1 : folded.index(" ", end + 1)] if end + 1 < len(folded) else ""
        return f"{before} {word}" in self.exceptions or f"{word} {after}" in self.exceptions

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, self.offset + self.slope * math.log1p(density)))) if self.weights else 0.0


def learn(toxic: list[str], clean: list[str], least_chars: int = 4, most_chars: int = 12, least_share: float = 0.005, least_rows: int = 3, least_weight: float = 2.5, entries: int = 5000, phrases: int = 5000) -> Lexicon:
    """Texts of both kinds -> a lexicon of at most `entries` entries and `phrases` exception phrases, those of most weight
    and most rows; both bounds, like that on the labelled rows, are far above what such a number of rows can show."""
    known: dict[str, str] = {}  # each word is held once, however often it comes
    toxic, clean = ([[known.setdefault(w, w) for w in fold(x).split()] for x in texts] for texts in (toxic, clean))
    if not toxic or not clean:
        return Lexicon()
    least_rows = max(least_rows, math.ceil(least_share * len(toxic)))
    begins_of = lambda w: (w[:n] for n in range(least_chars, min(len(w), most_chars) + 1))
    shown = Counter(p for words in toxic for p in {p for w in set(words) for p in begins_of(w)})
    wanted = {p for p, n in shown.items() if n >= least_rows}
    against = Counter(p for words in clean for p in {p for w in set(words) for p in begins_of(w) if p in wanted})
    ratio = lambda n, p: math.log((n + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (against[p] + 0.5))
    wanted = {p for p in wanted if ratio(shown[p], p) >= least_weight}
    # a row counts for a beginning if it shows it between words that no row before has shown it between
    rows, between = Counter(), defaultdict(set)
    for words in toxic:
        new = set()
        for k, w in enumerate(words):
            for p in begins_of(w):
                if p in wanted and (near := (words[k - 1] if k else "", w, words[k + 1] if k + 1 < len(words) else "")) not in between[p]:
                    between[p].add(near)
                    new.add(p)
        rows.update(new)
    weight = {p: ratio(rows[p], p) for p in wanted if rows[p] >= least_rows}
    good = {p for p, w in weight.items() if w >= least_weight}
    # of beginnings of each other, the shortest, made longer while nearly all of its rows have the longer one too
    kept: dict[str, float] = {}
    longer = defaultdict(list)
    for p in good:
        longer[p[:-1]].append(p)
    for p in sorted(good, key=lambda p: (len(p), p)):
        if any(p[:n] in good for n in range(least_chars, len(p))):
            continue
        while more := [q for q in longer[p] if rows[q] >= 0.98 * rows[p]]:
            p = more[0]
        kept[p] = weight[p]
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:entries])
    begins = tuple(kept)
    pairs = [Counter(), Counter()]
    for kind, texts in enumerate((clean, toxic)):
        for words in texts:
            found = set()
            for k, w in enumerate(words):
                if w.startswith(begins) if begins else False:
                    found |= {f"{a} {b}" for a, b in ((words[k - 1] if k else "", w), (w, words[k + 1] if k + 1 < len(words) else ""))}
            pairs[kind].update(found)
    exceptions = [p for p, n in pairs[0].most_common() if n >= 3 and not pairs[1][p]][:phrases]
    lex = Lexicon(kept, frozenset(exceptions))
    a = lex.automaton()
    x = np.log1p([lex.density(" " + " ".join(w) + " ", a) for w in [*toxic, *clean]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    share = np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean))
    lex.slope, lex.offset = _logistic(x, y, share)
    return lex


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """slope, offset by Newton's method; both kinds weigh the same."""
    m, b = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -50, 50)))
        grad = m.T @ (share * (p - y)) + ridge * b * [1, 0]
        step = np.linalg.solve((m * (share * p * (1 - p))[:, None]).T @ m + ridge * np.eye(2), grad)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_toxic: int = 1500, fit_clean: int = 4500) -> Lexicon:
    """Learns from labelled rows, a bounded number of either kind; they are in the order of a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    known = known.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id").withColumn("_h", F.xxhash64("_id"))
    # the ids first, so that only the chosen rows' texts travel
    ids = [known.where(F.col("_y") == kind).orderBy("_h", "_id").limit(most) for kind, most in ((1, fit_toxic), (0, fit_clean))]
    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.length("_t") > 0)
    got = got.join(F.broadcast(ids[0].union(ids[1])), "_id").groupBy("_y", "_h", "_id").agg(F.min("_t").alias("_t"))
    # one task learns, so the driver holds the lexicon and never the texts
    rows = got.coalesce(1).sortWithinPartitions("_h", "_id").select("_y", "_t")
    made = rows.mapInPandas(_learned, "lexicon binary").collect()
    return pickle.loads(made[0]["lexicon"]) if made else Lexicon()


def _learned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts: tuple[list[str], list[str]] = [], []
    for rows in parts:
        for kind, text in zip(rows["_y"], rows["_t"], strict=True):
            if kind in (0, 1):
                texts[kind].append(text)
    yield pd.DataFrame({"lexicon": [pickle.dumps(learn(texts[1], texts[0]))]})


def toxicity(lexicon: Lexicon, text: Column) -> Column:
    """A text's score."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for texts in parts:
            yield pd.Series([lexicon.score(lexicon.density(fold(x or ""), a)) for x in texts], dtype="float64")

    return score(text)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")), F.lit(0)) % 5 == 0


def score_all(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each row of docs: id_col, held_out, score, predicted. Labels of held-out rows aren't learned from."""
    lexicon = fit(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col, label_col)
    out = docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), toxicity(lexicon, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without the rows that score 0.5 or more."""
    lexicon = fit(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col, label_col)
    return docs.where(toxicity(lexicon, F.col(f"`{text_col}`")) < 0.5)


def matches(texts: Iterable[str], lexicon: Lexicon) -> list[list[str]]:
    """The entries found in each text, for a look at a decision."""
    a = lexicon.automaton()
    return [[folded[end - n + 2 : end + 1] for end, (n, _) in a.iter(folded)] for folded in map(fold, texts)]
