"""Fill-in-the-middle documents by an Aho-Corasick scan of events.

A text is a row of units (lines, words with the white space after them, or
characters). One automaton finds the ASCII characters that end a unit and the
sentinels; nothing else of the text is looked at. A unit count is arithmetic on
the gaps between events, and so is the place where the unit of a given rank
ends, so the two cuts need no list of units. A text that holds a sentinel, or
that the rate leaves out, stays plain.

The cuts, the rate and the order of the parts come from a hash of seed and id,
so reruns agree. ``restored`` gives the exact text back.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec

SEED = 7
SENTINELS = ("<P>", "<S>", "<M>")
FIM_PERCENT = 100
SPM_PERCENT = 50
#: Characters that end a unit; runs of them end it together where the flag is set. A character unit needs none.
UNITS = {"line": ("\n", False), "word": (" \t\n\x0b\x0c\r", True), "character": ("", False)}


class Scanner:
    """Events of a text, and cuts by rank."""

    def __init__(self, unit: str = "line", sentinels=SENTINELS):
        ends, self.joined = UNITS[unit]
        self.each = unit == "character"
        self.automaton = ahocorasick.Automaton()
        for c in ends:
            self.automaton.add_word(c, False)
        for s in sentinels:
            self.automaton.add_word(s, True)
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[list[int], bool]:
        """The ends of units that an event marks, in order, and whether the text holds a sentinel."""
        ends: list[int] = []
        held = False
        for at, sentinel in self.automaton.iter(text):
            if sentinel:
                held = True
            elif self.joined and ends and ends[-1] == at:
                ends[-1] = at + 1
            else:
                ends.append(at + 1)
        return ends, held

    def count(self, ends: list[int], length: int) -> int:
        """Units: one for each marked end, and those of the gap after the last."""
        gap = length - (ends[-1] if ends else 0)
        return len(ends) + (gap if self.each else gap > 0)

    def place(self, ends: list[int], length: int, rank: int) -> int:
        """Where the unit of that rank ends; 0 for rank 0."""
        if rank == 0:
            return 0
        if rank <= len(ends):
            return ends[rank - 1]
        return (ends[-1] if ends else 0) + rank - len(ends) if self.each else length


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from sha256 of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    sentinels=SENTINELS,
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for each row of ``docs``.

    ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or
    plain; plain texts are put out as they are and have null lengths. Null
    counts as empty, and empty texts are plain. Texts are read whole, whatever
    their length. Rows that repeat an id draw the same numbers. Sentinels are
    prefix, suffix and middle; the first character of each may be nowhere else
    in any of them, so that none can arise where parts meet. An empty table
    gives an empty result.
    """
    if any(s[:1] in "".join(x[1:] for x in sentinels) or not s for s in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ, and their first characters stand nowhere else in them")
    before, after, middle = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(unit, sentinels)
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                cols = {k: [] for k in ("n", "form", "prefix", "middle", "output")}
                texts, *drawn = (part.column(k).to_pylist() for k in range(1, 6))
                for text, h1, h2, h3, h4 in zip(texts, *drawn):
                    text = text or ""
                    (ends, held), form, a, b = scanner.events(text), "plain", None, None
                    n = scanner.count(ends, len(text))
                    if text and not held and h3 % 100 < fim_percent:
                        ranks = sorted((h1 % (n + 1), h2 % (n + 1)))
                        a, b = (scanner.place(ends, len(text), r) for r in ranks)
                        form = "spm" if h4 % 100 < spm_percent else "psm"
                        head, tail = before + text[:a], after + text[b:]
                        text = (tail + head if form == "spm" else head + tail) + middle + text[a:b]
                    for k, v in zip(cols, (n, form, a, None if a is None else b - a, text)):
                        cols[k].append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, t) for v, t in zip(cols.values(), kinds))],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *draws(id_col, seed)).mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: str = "output", form: str = "form", sentinels=SENTINELS) -> Column:
    """The text that ``output`` was made from."""
    out, spm = F.col(output), F.col(form) == "spm"
    before, after, middle = sentinels
    inner = F.when(spm, F.locate(before, out)).otherwise(F.locate(after, out))
    last = F.locate(middle, out)
    outer_size = F.when(spm, F.lit(len(after))).otherwise(F.lit(len(before)))
    inner_size = F.when(spm, F.lit(len(before))).otherwise(F.lit(len(after)))
    one = F.substring(out, outer_size + 1, inner - outer_size - 1)
    two = F.substring(out, inner + inner_size, last - inner - inner_size)
    three = F.substring(out, last + len(middle), F.length(out))
    whole = F.when(spm, F.concat(two, three, one)).otherwise(F.concat(one, three, two))
    return F.when(F.col(form) == "plain", out).otherwise(whole)


ORACLE_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h
  FROM documents),
d AS (
  SELECT *, len(l)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
