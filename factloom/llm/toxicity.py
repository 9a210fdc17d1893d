"""Toxicity after noisy-channel deobfuscation.

A character trigram model is counted over all documents. Stretches of any length that look disguised (figures, signs and look-alikes
of other scripts inside words, single characters set apart, characters repeated) become lattices of what each character may stand
for; Viterbi decoding over all states of the model picks the reading, and the restored text is scored. In such a stretch, runs of one
character are cut to three of it first, and marks that take no room are left out.

The score is a logistic model of the strongest word or word-beginning found and of their strength together. It is fitted on a
bounded sample, the SAMPLE labelled rows that come first by a hash of their id, all outside the held-out fifth (crc32 of the
id mod 5 = 0). Words count where they occur in toxic rows far more often than chance allows for so many words; rows that share a
text's smallest shingle hashes count once, so that copies of one toxic text don't make its other words suspicious.

Defined results: a null or empty text scores as one in which nothing was found; without labels of both kinds every score is
0; labels that are null or name no document are ignored; of rows that share a labelled id, the one whose text has the least hash is learnt from;
repeated rows and null ids are scored one by one; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, documents, filtered, id_and_text, held_out_remainder, one_text_each, shingle_hashes, steps, word_hashes, words_of

SAMPLE = 12_000
#: Words and beginnings that a model holds at most, the strongest first.
TERMS = 8192
#: Different words that a beginning must have to count by itself.
FAMILY = 5
#: What characters stand for in disguise (fixed values).
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "¡": "i"}
#: Letters of other scripts that look like Latin ones, and marks without width (fixed values).
LOOKS_LIKE = dict(zip("аеорсухіјѕԁԛԝкмтнвαικνορτυχ", "aeopcyxijsdqwkmthbaikvoptux", strict=True)) | {chr(0xFF41 + i): chr(ord("a") + i) for i in range(26)}
WITHOUT_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Symbols of the character model: 0 for anything that is no letter, then letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
SIZE = 64

CODE = np.full(0x180, 0, np.uint8)
for _i, _c in enumerate(LETTERS):
    CODE[ord(_c)] = CODE[ord(_c.upper()) if len(_c.upper()) == 1 and ord(_c.upper()) < 0x180 else ord(_c)] = _i + 1

#: What may set characters of one word apart.
_BETWEEN = r" ._\-*/|~"
_DISGUISED = re.compile(
    r"(?<!\S)(?=\S*[^\W\d_])(?=\S*(?:[0-9@$|+(€£*¡" + WITHOUT_WIDTH + r"]|!(?=\w)|(\w)\1\1|(?<=[a-z])[" + "".join(LOOKS_LIKE) + "]|[" + "".join(LOOKS_LIKE) + r"](?=[a-z])))\S{2,}(?!\S)"
    rf"|(?<![^\W_])(?:[^\W_][{_BETWEEN}]{{1,4}}){{3,}}[^\W_](?![^\W_])|(?<![^\W_])(?:[\w@$!|+(*][ ._\-]){{3,}}[\w@$!|+*](?![^\W_])"
)
#: Bits by character for finding where a match may lie at all.
_SPACE, _ALNUM, _SIGN, _APART, _ELEMENT = 1, 2, 4, 8, 16


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.zeros(1 << 16, np.uint8)
    signs = set("0123456789@$|+(€£*¡!" + WITHOUT_WIDTH) | set(LOOKS_LIKE)
    for i in range(1 << 16):
        c = chr(i)
        word = re.match(r"\w", c) is not None
        kinds[i] = _SPACE * c.isspace() | _ALNUM * (word and c != "_") | _SIGN * (c in signs) | _APART * (c in " ._-") | _ELEMENT * (word or c in "@$!|+(*")
    # Stands for all characters beyond.
    kinds[-1] = _ALNUM | _ELEMENT
    return kinds


def suspicious(text: str) -> list[tuple[int, int]]:
    """Stretches from white space to white space outside of which _DISGUISED matches nothing."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 2:
        return []
    kinds = _kinds()[np.minimum(points, 0xFFFF)]
    has = lambda bit: (kinds & bit) != 0
    alnum = has(_ALNUM)
    found = [np.flatnonzero(has(_SIGN)), np.flatnonzero((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & has(_ELEMENT)[2:])]
    runs = [(x, x + 1) for x in found]
    # Four single characters or more, a few marks between them.
    padded = np.concatenate([[False], alnum, [False]])
    single = np.flatnonzero(alnum & ~padded[:-2] & ~padded[2:])
    if len(single) > 3:
        near = single[3:] - single[:-3]
        steps_ = np.maximum(np.maximum(single[1:-2] - single[:-3], single[2:-1] - single[1:-2]), single[3:] - single[2:-1])
        at = np.flatnonzero(steps_ <= 5)
        runs.append((single[at], single[at] + near[at] + 1))
    if len(points) > 6:
        then = has(_ELEMENT)[:-1] & has(_APART)[1:]
        at = np.flatnonzero(then[:-5] & then[2:-3] & then[4:-1] & has(_ELEMENT)[6:])
        runs.append((at, at + 7))
    starts, ends = (np.concatenate(x) for x in zip(*runs, strict=True))
    if not len(starts):
        return []
    spaces = np.flatnonzero(has(_SPACE))
    bounds = np.concatenate([[-1], spaces, [len(points)]])
    starts, ends = bounds[np.searchsorted(spaces, starts, "left")] + 1, bounds[np.searchsorted(spaces, ends - 1, "left") + 1]
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[1:] > ends[:-1])
    return list(zip(starts[fresh].tolist(), ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)].tolist(), strict=True))


_RUN = re.compile(r"(\S)\1{3,}")
_NO_WIDTH = re.compile(f"[{WITHOUT_WIDTH}]")
_WORD = re.compile(r"[^\W\d_]+")


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CODE[np.minimum(points, 0x17F)]


def trigram_counts(texts: list[str]) -> np.ndarray:
    c = codes("\n" + "\n\n".join(texts) + "\n").astype(np.int64)
    return np.bincount(c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for _, texts in steps(batches):
        total += trigram_counts(texts)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array((there // SIZE).astype(np.int32)), pa.array((there % SIZE).astype(np.int32)), pa.array(total[there])], ["pair", "next", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | two before) as a 64 x 64 x 64 array, from all texts; its size doesn't depend on theirs."""
    n = np.zeros((SIZE * SIZE, SIZE))
    found = docs.select("doc_id", "text").mapInArrow(_count, "pair int, next int, n long").groupBy("pair", "next").agg(F.sum("n").alias("n")).toArrow()
    n[found["pair"].to_numpy(), found["next"].to_numpy()] = found["n"].to_numpy()
    tri = n.reshape(SIZE, SIZE, SIZE)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * SIZE)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Viterbi decoding of disguised stretches; states are the last two symbols."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def __call__(self, text: str) -> str:
        text = text.lower()
        out, at = [], 0
        for a, b in suspicious(text):
            for m in _DISGUISED.finditer(text, a, b):
                out += [text[at : m.start()], self.decode(m[0])]
                at = m.end()
        return "".join([*out, text[at:]])

    def decode(self, stretch: str) -> str:
        """The likeliest reading; trailing stops are kept as they are."""
        core = _RUN.sub(r"\1\1\1", _NO_WIDTH.sub("", stretch)).rstrip(".,;:!?\"')")
        if len(core) < 2:
            return stretch
        if core not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[core] = self._viterbi(core)
        return self.known[core] + stretch[len(stretch.rstrip(".,;:!?\"')")) :]

    def options(self, s: str, i: int) -> list[tuple[str, float]]:
        """What s[i] may stand for, with costs; '' leaves it out."""
        c = s[i]
        out = [(x, 0.7) for x in STANDS_FOR.get(c, "")]
        if c in LOOKS_LIKE:
            out.append((LOOKS_LIKE[c], 0.2))
        if c.isalpha():
            out.append((c, 0.0))
            if i and s[i - 1] == c:
                again = i > 1 and s[i - 2] == c or i + 1 < len(s) and s[i + 1] == c
                out.append(("", 0.1 if again else 3.0))
        elif c in " ._-/~|*":
            # A sign between two single characters sets them apart; a space may also end a word.
            apart = (i < 2 or not s[i - 2].isalnum()) or (i + 2 >= len(s) or not s[i + 2].isalnum())
            out += [("", 0.0 if apart else 5.0), (" ", 2.5 if c == " " else 5.0)] if c not in "|*" else [("", 0.0 if apart else 4.0), (c, 4.0)]
        else:
            out.append((c, 4.0))
        return out

    def _viterbi(self, s: str) -> str:
        best = {(0, 0): (0.0, None)}
        for i in range(len(s)):
            after: dict = {}
            for (a, b), (score, path) in best.items():
                for out, cost in self.options(s, i):
                    if out:
                        c = int(CODE[min(ord(out), 0x17F)])
                        state, total, tail = (b, c), score + float(self.model[a, b, c]) - cost, (path, out)
                    else:
                        # Leaving a letter out costs about as much as an average one, so that short readings aren't favoured as such.
                        state, total, tail = (a, b), score - cost - (1.5 if s[i].isalnum() else 0.0), path
                    if state not in after or after[state][0] < total:
                        after[state] = (total, tail)
            best = after
        total, path = max(((score + float(self.model[a, b, 0]), path) for (a, b), (score, path) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out))


class Model(NamedTuple):
    terms: dict[str, float]
    weights: tuple[float, ...]

    def evidence(self, restored: str) -> tuple[float, float, float]:
        """The strongest term, all terms' strength together, and that strength by the number of distinct words."""
        get, most, total = self.terms.get, 0.0, 0.0
        words = set(_WORD.findall(restored))
        for w in words:
            x = max(get(w, 0.0), get("^" + w[:4], 0.0), get("^" + w[:5], 0.0), get("^" + w[:6], 0.0))
            if x:
                total += x
                most = max(most, x)
        return most, math.log1p(total), math.log1p(100 * total / (len(words) + 10))

    def score(self, restored: str) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.evidence(restored), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms_of(restored: str) -> set[str]:
    words = set(_WORD.findall(restored))
    return words | {"^" + w[:k] for w in words for k in (4, 5, 6) if len(w) > k}


def _fit_terms(texts: list[str], y: list[int]) -> dict[str, float]:
    """Terms and the logarithms of their odds; only what several toxic texts hold is counted at all."""
    seen: set[int] = set()
    kept: dict[bool, list[str]] = {True: [], False: []}
    for text, label in zip(texts, y, strict=True):
        least = np.sort(shingle_hashes(word_hashes(words_of(text)), 5))[:3].tolist()
        if not any(x in seen for x in least):
            seen.update(least)
            kept[bool(label)].append(text)
    n_bad, n_good = len(kept[True]), len(kept[False])
    if not n_bad or not n_good:
        return {}
    bad: Counter = Counter()
    for text in kept[True]:
        bad.update(_terms_of(text))
    good: Counter = Counter()
    for text in kept[False]:
        good.update(t for t in _terms_of(text) if t in bad)
    many = Counter(t + good[term] for term, t in bad.items())
    at_least, total = {}, 0
    for df in sorted(many, reverse=True):
        at_least[df] = total = total + many[df]
    share, out = n_bad / (n_bad + n_good), {}
    for term, t in bad.items():
        c = good[term]
        if t < 3 or t / (t + c) < max(0.8, share):
            continue
        # By how much the term's rows are toxic beyond their share, against what the luckiest of as many terms would show.
        surprise = t * math.log(t / (t + c) / share) + (c * math.log(c / (t + c) / (1 - share)) if c else 0)
        if surprise > math.log(at_least[t + c]) + 4:
            out[term] = math.log((t + 0.5) / (c + 0.5))
    # A beginning that few words share says no more than those words.
    families: dict[str, set[str]] = {term[1:]: set() for term in out if term[0] == "^"}
    for text in kept[True] if families else ():
        for w in set(_WORD.findall(text)):
            for k in (4, 5, 6):
                if (words := families.get(w[:k])) is not None and len(words) < FAMILY:
                    words.add(w)
    out = {term: x for term, x in out.items() if term[0] != "^" or len(families[term[1:]]) >= FAMILY}
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:TERMS])


def _fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, lightly held towards 0."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, chars: np.ndarray, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows of docs (doc_id, text); their texts come to the driver."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = rows.filter(crc_mod(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars)
        for ids, texts in steps(batches, "y"):
            # Each distinct word once: order and counts don't matter to the model, and a long text stays small.
            restored = [" ".join(dict.fromkeys(restorer(t).split())) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ids], pa.int64()), pa.array([y for _, y in ids], pa.int32()), pa.array(restored, pa.string())], ["doc_id", "y", "text"])

    got = one_text_each(docs, rows).mapInArrow(restore, "doc_id long, y int, text string").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, y = got["text"].to_pylist(), got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Model({}, (-30.0, 0.0, 0.0, 0.0))
    terms = _fit_terms(texts, y.tolist())
    found = Model(terms, (0.0,) * 4)
    return Model(terms, _fit_weights(np.array([found.evidence(t) for t in texts]), y.astype(float)))


SCORED = "doc_id long, held_out boolean, score double, predicted int, restored string"


def _score(chars: np.ndarray, model: Model, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars)
        for ids, texts in steps(batches):
            restored = [restorer(t) for t in texts]
            scores = [model.score(t) for t in restored]
            columns = [pa.array(ids, pa.int64()), pa.array([held_out_remainder(i, 5) == 0 for i in ids]), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(restored if with_text else [None] * len(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Every row's toxicity and, with_text, its restored lower-case text."""
    docs = id_and_text(docs, id_col, text_col)
    chars = character_model(docs)
    model = fit(docs, labels, chars)
    return docs.mapInArrow(_score(chars, model, with_text), SCORED)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't toxic; each row is judged by its own text."""
    chars = character_model(id_and_text(docs, id_col, text_col))
    model = fit(id_and_text(docs, id_col, text_col), labels, chars)

    def keep():
        restorer = Restorer(chars)
        return lambda texts: [model.score(restorer(t)) < 0.5 for t in texts]

    return filtered(docs, text_col, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), with_text=False).drop("restored")
