"""License scans by conditional compression.

A block is a run of words around a word of license language, over line ends, as long as the longest template reaches; long runs are cut
into blocks that overlap by a template's reach. A block is compressed with zstandard once alone and once with each template as a raw
dictionary; templates are ranked by how much smaller the block gets. All whose words the block has, but for a small share, are then
compared word by word, whatever they save, and a notice is reported only where the template's own words are all there, but for a small share; the differences are reported with it.

Defined results: a null or empty text has no blocks; `line` is the one on which a notice begins; of notices that overlap the one that
explains most words is reported, each difference counting against two (on ties the one with fewer differences, the larger reduction, then the name), and each
license once for a line; very long texts are scanned in overlapping blocks; repeated rows and null ids are scanned one by one; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import documents, id_and_text, steps
from factloom.llm.license_texts import TEMPLATES

#: Between the words of a cue may be a line end and comment marks.
CUE = re.compile(r"licen[cs]e|copyright|rights[\W_]+(?:(?:rem|dnl)\s+)?reserved|permission|redistribution|public[\W_]+(?:(?:rem|dnl)\s+)?domain|creative[\W_]+(?:(?:rem|dnl)\s+)?commons", re.IGNORECASE)
#: Comment marks that are words.
MARK = re.compile(r"^\W*(?:rem|dnl)\s", re.IGNORECASE)
#: Words of a block.
BLOCK = 640
#: The share of a template's words that may be missing or come between.
DIFFERENT = 0.1

_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@functools.cache
def _compressors() -> tuple:
    alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
    given = {}
    for name, text in TEMPLATES.items():
        # Raw dictionaries need some length; a template is repeated to it.
        raw = (" ".join(words(text)) + " ").encode()
        raw *= max(1, -(-64 // len(raw)))
        given[name] = zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return alone, given


def reductions(block: list[str]) -> list[tuple[float, str]]:
    """(share of the block's compressed size that a template saves, its name), the largest first."""
    alone, given = _compressors()
    raw = " ".join(block).encode()
    size = len(alone.compress(raw))
    return sorted(((size - len(c.compress(raw))) / size, name) for name, c in given.items())[::-1]


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words that stand between those it has."""
    return compared(template, block)[:2]


def compared(template: list[str], block: list[str]) -> tuple[list[str], list[str], int, int]:
    """The differences, and where the notice begins and ends in the block."""
    found = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not found:
        return list(template), [], 0, 0
    # The stretch around the longest match holds the notice; what matches far from it is other text.
    most = max(found, key=lambda m: (m.size, -m.b))
    reach = len(template)
    near = [m for m in found if most.b - reach <= m.b and m.b + m.size <= most.b + most.size + reach]
    here = {i for m in near for i in range(m.a, m.a + m.size)}
    inside = {i for m in near for i in range(m.b, m.b + m.size)}
    start, end = near[0].b, near[-1].b + near[-1].size
    return [w for i, w in enumerate(template) if i not in here], [block[i] for i in range(start, end) if i not in inside], start, end


@functools.cache
def _wanted() -> dict[str, tuple[list[str], Counter]]:
    return {name: (words(text), Counter(words(text))) for name, text in TEMPLATES.items()}


def _notices(name: str, block: list[str], lo: int, hi: int) -> Iterator[tuple[list[str], list[str], int, int]]:
    """Where a template is in block[lo:hi], with its differences; on both sides of what is found, and in overlapping halves if the longest match is no notice."""
    template, counts = _wanted()[name]
    n, allowed = len(template), DIFFERENT * len(template)
    # Exact: a notice has all words but the allowed ones.
    if hi - lo < n - allowed or n - (counts & Counter(block[lo:hi])).total() > allowed:
        return
    missing, extra, a, b = compared(template, block[lo:hi])
    if len(missing) + len(extra) <= allowed:
        yield missing, extra, lo + a, lo + b
        yield from _notices(name, block, lo, lo + a)
        yield from _notices(name, block, lo + b, hi)
    elif hi - lo > 2 * (n + int(allowed)) + 2:
        middle = (lo + hi) // 2
        yield from _notices(name, block, lo, middle + n + int(allowed))
        yield from _notices(name, block, middle, hi)


def _blocks(found: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words around the cues."""
    reach = max(int((1 + DIFFERENT) * len(t)) + 1 for t, _ in _wanted().values())
    starts = np.cumsum([0, *[len(w) + 1 for w in found[:-1]]])
    runs: list[list[int]] = []
    for cue in CUE.finditer(" ".join(found)):
        k = int(np.searchsorted(starts, cue.start(), "right")) - 1
        lo, hi = max(0, k - reach), min(len(found), k + reach + 1)
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    for lo, hi in runs:
        while hi - lo > BLOCK:
            yield lo, lo + BLOCK
            lo += BLOCK - reach
        yield lo, hi


def _candidates(block: list[str]) -> list[tuple[float, str]]:
    """Templates to compare word by word: those whose words the block has, but for the allowed ones."""
    have = Counter(block)
    near = {name for name, (template, counts) in _wanted().items() if len(template) - (counts & have).total() <= DIFFERENT * len(template)}
    return [x for x in reductions(block) if x[1] in near] if near else []


def scan_text(text: str) -> Iterator[tuple]:
    """(line, license, reduction, missing, extra) of the notices of a text, in order."""
    found, lines = [], []
    for k, line in enumerate(text.split("\n")):
        here = words(MARK.sub("", line))
        found += here
        lines += [k] * len(here)
    hits = []
    for lo, hi in _blocks(found):
        for saved, name in _candidates(found[lo:hi]):
            for missing, extra, a, b in _notices(name, found, lo, hi):
                differ = len(missing) + len(extra)
                hits.append((2 * differ - len(_wanted()[name][0]), differ, -saved, name, a, b, missing, extra))
    taken: list[tuple[int, int]] = []
    out = {}
    for _, _, saved, name, a, b, missing, extra in sorted(hits, key=lambda h: h[:6]):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.setdefault((lines[a], name), (lines[a], name, -saved, missing, extra))
    yield from (out[k] for k in sorted(out))


FOUND = "doc_id long, line int, license string, reduction double, missing array<string>, extra array<string>, exact boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_())
    for ids, texts in steps(batches):
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            if CUE.search(text):
                rows += [(doc_id, *hit, not hit[3] and not hit[4]) for hit in scan_text(text)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license notice."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
