"""Fill-in-the-middle transformation, in SQL over Arrow batches.

A document's tokens are words with the white space before them. Two cuts, drawn from a hash of the document's key,
part them into prefix, middle and suffix, and half of the documents are put in another order, with marks, so that a
model learns to fill in what stands between. Each batch is registered with an embedded SQL engine within
`mapInArrow`: all texts of a batch are cut, joined and hashed by its vectorised functions, no row by Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import WS, batch_slices

#: A word with the white space before it; or white space that no word follows.
UNIT = rf"[{WS}]*[^{WS}]+|[{WS}]+"


@dataclass(frozen=True)
class Recipe:
    """How many per cent of the documents change, how many of these have the suffix first, the seed of the draws, and the marks.

    The marks begin and end with different characters that occur nowhere else in them, so none overlaps another.
    """

    percent: int = 50
    suffix_first: int = 80
    seed: int = 42
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    def __post_init__(self) -> None:
        for m in (self.prefix_mark, self.suffix_mark, self.middle_mark):
            if len(m) < 2 or m.count(m[0]) > 1 or m.count(m[-1]) > 1 or {m[0], m[-1]} != {self.prefix_mark[0], self.prefix_mark[-1]}:
                raise ValueError(f"{m!r} may overlap another mark")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(r: Recipe, carry: int = 0) -> str:
    """Of `batch` (k, t, c0, c1, ...): k, n, form, prefix_chars, middle_chars, output, c0, c1, ..."""
    p, s, m = map(_quoted, (r.prefix_mark, r.suffix_mark, r.middle_mark))
    more = "".join(f", c{i}" for i in range(carry))
    draw = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    joined = lambda low, high: f"coalesce(array_to_string(list_slice(units, {low}, {high}), ''), '')"
    return f"""
WITH drawn AS (SELECT *, coalesce(t, '') AS text, sha256('{r.seed}:' || coalesce(CAST(k AS VARCHAR), '')) AS h FROM batch),
cut AS (SELECT *, CASE WHEN text <> '' THEN regexp_extract_all(text, '{UNIT}') ELSE [] END AS units,
  text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(2)} % 100 >= {r.percent} AS plain, {draw(3)} % 100 < {r.suffix_first} AS suffix_first FROM drawn),
placed AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least({draw(0)} % (len(units) + 1), {draw(1)} % (len(units) + 1)) AS a, greatest({draw(0)} % (len(units) + 1), {draw(1)} % (len(units) + 1)) AS b FROM cut),
parted AS (SELECT *, CASE WHEN NOT plain THEN {joined("1", "a")} END AS prefix, CASE WHEN NOT plain THEN {joined("a + 1", "b")} END AS middle, CASE WHEN NOT plain THEN {joined("b + 1", "n")} END AS suffix FROM placed)
SELECT k, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
  CASE WHEN plain THEN text WHEN suffix_first THEN {s} || suffix || {p} || prefix || {m} || middle ELSE {p} || prefix || {s} || suffix || {m} || middle END AS output{more} FROM parted"""


def restore_sql(r: Recipe, carry: int = 0) -> str:
    """Of `batch` (t, f, c0, c1, ...), an output and its form: the text, and c0, c1, ..."""
    p, s, m = map(_quoted, (r.prefix_mark, r.suffix_mark, r.middle_mark))
    more = "".join(f", c{i}" for i in range(carry))
    return f"""
WITH parts AS (SELECT *, string_split(t, CASE f WHEN 'spm' THEN {p} ELSE {s} END) AS halves FROM batch),
ends AS (SELECT *, string_split(halves[2], {m}) AS tail FROM parts)
SELECT CASE f WHEN 'psm' THEN substr(halves[1], {len(r.prefix_mark) + 1}) || tail[2] || tail[1] WHEN 'spm' THEN tail[1] || tail[2] || substr(halves[1], {len(r.suffix_mark) + 1}) ELSE t END AS text{more} FROM ends"""


def in_sql(rows: DataFrame, sql: str, names: Sequence[str], schema: str) -> DataFrame:
    """What `sql` makes of each batch of `rows`, registered as `batch` with columns of these names; the first string column bounds a batch's bytes.

    One engine a task, on one thread, in memory; batches are cut by the bytes of their texts, a longer text stands alone.
    """
    text = next(i for i, f in enumerate(rows.schema.fields) if f.dataType.simpleString() == "string" and names[i] == "t")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False}) as engine:
            for batch in batches:
                for part in batch_slices(batch, text):
                    engine.register("batch", pa.Table.from_batches([part.rename_columns(list(names))]))
                    yield from engine.sql(sql).to_arrow_table().to_batches()
                    engine.unregister("batch")

    return rows.mapInArrow(each, schema)


def transform(docs: DataFrame, recipe: Recipe = Recipe(), key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:  # noqa: B008
    """(key, n, form, prefix_chars, middle_chars, output, *carry): every whole text with its parts in the order of its form.

    The form is plain (the text as it was, lengths null) for empty texts, texts that hold a mark and those that were not drawn; psm: prefix,
    suffix, middle; spm: suffix, prefix, middle. n is the number of tokens. Draws follow from seed and key, so rows of
    one key share them and reruns agree. Null texts are empty; a null key draws as an empty one; repeated rows come out
    each; columns that are not named in `carry` are dropped, and a carried one may have any name but those of the result.
    """
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    more = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return in_sql(rows, transform_sql(recipe, len(carry)), rows.columns, f"`{key}` {kinds[key]}, n long, form string, prefix_chars long, middle_chars long, output string{more}")


def restore(outputs: DataFrame, recipe: Recipe = Recipe(), carry: Sequence[str] = (), output: str = "output", form: str = "form") -> DataFrame:  # noqa: B008
    """(text, *carry): the exact texts that outputs and forms of `transform` were made of; null outputs give null."""
    kinds = dict(outputs.dtypes)
    rows = outputs.select(F.col(output).alias("t"), F.col(form).alias("f"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    return in_sql(rows, restore_sql(recipe, len(carry)), rows.columns, "text string" + "".join(f", `{c}` {kinds[c]}" for c in carry))


def digest(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:  # noqa: B008
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, the last from what `restore` gives."""
    made = transform(docs, recipe)
    made = made.withColumn("output_sha256", F.sha2("output", 256))
    back = restore(made, recipe, carry=("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("text", 256).alias("restored_sha256"))
