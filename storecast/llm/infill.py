"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put in another order.

The tokenizers library's Split pre-tokenizer gives the code-point offsets of a
text's units; nothing is trained. The number of offsets is the number of units,
and the offset of a rank is where a slice ends. Choices, slices and output are
built-in expressions on the text as it stands; only offsets come from Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units are lines with their line end; SEED, RATE and SPM are those of production.
LINES, SEED, RATE, SPM = r"[^\n]*\n|[^\n]+", 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that Split gets at once: its offsets take some hundred bytes for each.
PIECE = 1 << 14


def unit_ends(text: str, split, piece: int = PIECE) -> list[int]:
    """The code-point offset of every line's end. A piece may end within a line: then the line's end is in a later piece."""
    from tokenizers import PreTokenizedString

    ends: list[int] = []
    for start in range(0, len(text), piece):
        part = PreTokenizedString(text[start : start + piece])
        split.pre_tokenize(part)
        # The line that the last piece left open goes on here.
        if ends and text[start - 1] != "\n":
            ends.pop()
        ends.extend(start + end for _, (_, end), _ in part.get_splits("original", "char"))
    return ends


@F.arrow_udf(T.ArrayType(T.IntegerType(), False))
def line_ends(text: pa.Array) -> pa.Array:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(LINES), "isolated")
    return pa.array([unit_ends(x.as_py() or "", split) for x in text], pa.list_(pa.field("element", pa.int32(), nullable=False)))


def _choice(doc_id: Column, seed: int, k: int) -> Column:
    """The kth group of eight digits of the id's hash as a number."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digits, 8 * k - 7, 8), 16, 10).cast("long")


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Per row of ``docs``: doc_id, n (lines), form, prefix_chars, middle_chars, text, output.

    Form is plain (the text as it is) if the text is null, empty or holds one of
    the three marks, or for 100 - ``rate`` in a hundred ids; else spm for ``spm``
    in a hundred ids and psm for the others. The cuts depend on the seed, the id
    and the number of lines alone; rows that repeat an id are cut by the same
    numbers. A null id counts as an empty one. A null text counts as empty; texts
    of any length are cut whole, a piece at a time. No rows: an empty result.
    Other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("ends", line_ends("text")).withColumn("n", F.size("ends").cast("long"))
    one, other = (_choice(F.col("doc_id"), seed, k) % (F.col("n") + 1) for k in (1, 2))
    marked = F.contains(F.col("text"), F.lit(PREFIX)) | F.contains(F.col("text"), F.lit(SUFFIX)) | F.contains(F.col("text"), F.lit(MIDDLE))
    plain = (F.length("text") == 0) | marked | (_choice(F.col("doc_id"), seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_choice(F.col("doc_id"), seed, 4) % 100 < spm, "spm").otherwise("psm")
    end = lambda rank: F.when(rank == 0, 0).otherwise(F.get(F.col("ends"), (rank - 1).cast("int")))
    rows = rows.select("doc_id", "n", "text", form.alias("form"), end(F.least(one, other)).cast("long").alias("a"), end(F.greatest(one, other)).cast("long").alias("b"))
    slice_of = lambda start, size: F.substr(F.col("text"), (start + 1).cast("int"), size.cast("int"))
    prefix, middle = slice_of(F.lit(0), F.col("a")), slice_of(F.col("a"), F.col("b") - F.col("a"))
    suffix = F.substr(F.col("text"), (F.col("b") + 1).cast("int"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_text = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), "text",
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_text).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Each mark stands in a cut output once, so its first place is its place."""
    between = lambda a, b: F.substring_index(F.substr(output, F.instr(output, a) + len(a)), b, 1)
    last = F.substr(output, F.instr(output, MIDDLE) + len(MIDDLE))
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))).otherwise(output)
    )
