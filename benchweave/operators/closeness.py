"""Pairs of close texts by partition signatures: an equi-join on text segments instead of all pairs.

If two texts differ in at most d edits, and one of them is cut into d+1 segments, one segment stands unchanged in the
other, shifted by no more than the edits beside it. The cutoff bounds d for every text length, so the candidates' cut
segments form an inverted index (scope, length, segment number, segment), and a name asks for the few substrings that
could be one of them. Only pairs that share an entry are compared; the comparison is part of the join, so that pairs
that fail it are never rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLACK = 1e-9  # bounds are rounded outwards; the score itself decides


@dataclass(frozen=True)
class Measure:
    """How a cutoff bounds lengths and edits, as SQL text.

    Edit ratios are 1 - edits / longer length. Overlap ratios are 2 * matched characters / both lengths with matches in
    the same order: unmatched characters are insertions and deletions, so their number bounds the edits.
    """

    overlap: bool = False

    def check(self, cutoff: float) -> str:
        """The cutoff as text; below these limits texts could be cut into more segments than they have characters."""
        least = 2 / 3 if self.overlap else 0.5
        if not least < cutoff <= 1:
            raise ValueError(f"the cutoff must lie above {least:.3f}")
        return f"{cutoff!r}D"

    def reach(self, cutoff: str) -> str:
        """Least ratio of the shorter to the longer length."""
        return f"({cutoff} / (2 - {cutoff}))" if self.overlap else cutoff

    def budget(self, cutoff: str, size: str) -> str:
        """Most edits of any pair whose candidate has ``size`` characters."""
        slope = f"({2 if self.overlap else 1} * (1 - {cutoff}) / {cutoff})"
        return f"int(floor(({size}) * {slope} + {_SLACK}D))"

    def allowed(self, cutoff: str, n: str, size: str) -> str:
        """Most edits of a pair with these lengths."""
        length = f"({n} + {size})" if self.overlap else f"greatest({n}, {size})"
        return f"int(floor({length} * (1 - {cutoff}) + {_SLACK}D))"


SIDE = ("_scope", "_text", "_pad", "_cutoff")


def _parts(size: str, budget: str) -> str:
    """Segments as (number, start, stop); a text too short for one character a segment is the one segment -1, which is
    empty and fits all."""
    cut = "p -> struct(p AS _part, int(p * {0} DIV ({1} + 1)) AS _start, int((p + 1) * {0} DIV ({1} + 1)) AS _stop)".format(size, budget)
    return f"inline(CASE WHEN {budget} >= {size} THEN array(struct(-1 AS _part, 0 AS _start, 0 AS _stop)) ELSE transform(sequence(0, {budget}), {cut}) END)"


def segment_index(candidates: DataFrame, measure: Measure) -> DataFrame:
    """One row per segment: ``candidates`` with ``_size``, ``_part`` and ``_segment``."""
    sized = candidates.selectExpr("*", "length(_text) AS _size", f"{measure.budget('_cutoff', 'length(_text) + _pad')} AS _budget")
    rows = sized.selectExpr("*", _parts("_size", "_budget"))
    return rows.selectExpr(*candidates.columns, "_size", "_part", "substring(_text, _start + 1, _stop - _start) AS _segment")


def segment_probes(names: DataFrame, measure: Measure) -> DataFrame:
    """Per name, candidate length and segment number: the distinct substrings that could be that segment."""
    reach = measure.reach("_cutoff")
    least = f"int(greatest(ceil((length(_text) + _pad) * {reach} - {_SLACK}D) - _pad, 0))"
    most = f"int(floor((length(_text) + _pad) / {reach} + {_SLACK}D) - _pad)"
    bounded = names.selectExpr("*", f"{least} AS _least", f"{most} AS _most")
    sizes = f"transform(sequence(_least, _most), s -> struct(s AS _size, {measure.budget('_cutoff', 's + _pad')} AS _budget, length(_text) - s AS _shift))"
    sized = bounded.selectExpr("*", f"inline(CASE WHEN _least <= _most THEN {sizes} END)")
    rows = sized.selectExpr("*", _parts("_size", "_budget"))
    # Edits left and right of a segment together stay within the budget.
    first = "greatest(_start - _part, _start + _shift - (_budget - _part), 0)"
    last = "least(_start + _part, _start + _shift + (_budget - _part), length(_text) - (_stop - _start))"
    found = "array_distinct(transform(sequence(_first, _last), at -> substring(_text, at + 1, _stop - _start)))"
    bounds = rows.selectExpr("*", f"{first} AS _first", f"{last} AS _last")
    probes = bounds.selectExpr("*", f"explode(CASE WHEN _part < 0 THEN array('') WHEN _first <= _last THEN {found} END) AS _segment")
    return probes.select(*names.columns, "_size", "_part", "_segment")


def close_pairs(names: DataFrame, candidates: DataFrame, measure: Measure, keep: Sequence[str], where: str = "true") -> DataFrame:
    """Distinct pairs that may reach the cutoff: ``keep`` of the names and ``keep`` columns of the candidates as ``r_*``.

    Exact for edit ratios, a superset for overlap ratios. Both sides carry, per row: ``_scope``, which must be equal in
    a pair; ``_text``, what to compare; ``_pad``, the length of a common beginning that the scope guarantees and the text
    leaves out, so that segments are not spent on what all pairs share; and ``_cutoff``, the same on both sides of a
    scope. ``where`` is a further condition on name columns and candidate columns (``r_*``).
    """
    probes, index = segment_probes(names, measure), segment_index(candidates, measure)
    index = index.toDF(*[f"r_{c}" for c in index.columns])
    # With its limit the built-in distance stops early, and is -1 beyond it.
    limit = measure.allowed("_cutoff", "(length(_text) + _pad)", "(length(r__text) + _pad)")
    tests = [f"levenshtein(_text, r__text, {limit}) >= 0", f"({where})"]
    tests += [f"{c} = r_{c}" for c in ("_scope", "_size", "_part", "_segment")]
    met = probes.join(index, F.expr(" AND ".join(tests)))
    return met.select(*[c for c in met.columns if c in keep or c.removeprefix("r_") in keep]).distinct()
