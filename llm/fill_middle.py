"""Fill-in-middle transformation: DuckDB inside mapInArrow.

Each Arrow batch is registered with a DuckDB connection of the task, in runs of rows of
at most RUN_BYTES of text, and one SQL statement cuts the texts into units
(regexp_extract_all), takes the parts (list_slice, array_to_string), draws the cuts and
the form from sha256 of the key, and rebuilds the text from output and form alone; the
result goes back as Arrow, without Python per row.  There is no shuffle.

The marks `<P>`, `<S>` and `<M>` are told apart from the text because no text that holds
one is transformed, and none can arise where a part meets a mark.

Defined results: a null text is an empty one, which stays plain; texts are read whole
(memory is that of the longest text's units); repeated rows give equal rows each; a null
key counts as the empty string; keys of any type with a string form; an empty table
gives an empty result; further columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkernel import blocks

#: Parameters: shares (of 100) of texts that are transformed, and of those in the order suffix, prefix, middle; seed of the draw; bytes of text in one statement.
TRANSFORMED, SUFFIX_FIRST, SEED, RUN_BYTES = 90, 20, "1:", 4_000_000

#: What rebuilds the text from `output` and `form`.
RESTORE = """CASE form
  WHEN 'psm' THEN split_part(substr(output, 4), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
  WHEN 'spm' THEN split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(substr(output, 4), '<P>', 1)
  ELSE output END"""

UNITS = "[A-Za-z]+|[^A-Za-z]"


def _transform_sql(transformed: int, suffix_first: int) -> str:
    draw = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)"
    return f"""
WITH units AS (
  SELECT k, body, regexp_extract_all(body, '{UNITS}') AS u, sha256($seed || coalesce(CAST(k AS VARCHAR), '')) AS h FROM (SELECT k, coalesce(body, '') AS body FROM batch)
), drawn AS (
  SELECT k, body, u, CAST(len(u) AS BIGINT) AS n, {draw(0)} % (len(u) + 1) AS a, {draw(1)} % (len(u) + 1) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR {draw(2)} % 100 >= {transformed} THEN 'plain'
      WHEN {draw(3)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT k, body, n, form,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, least(a, b)), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, greatest(a, b) + 1, n), '') END AS suffix
  FROM drawn
), written AS (
  SELECT k, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
    CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END AS output
  FROM parts
)
SELECT k, n, form, prefix_chars, middle_chars, output, {RESTORE} AS restored FROM written"""


def _through_duckdb(statement: str, parameters: dict[str, str], schema: pa.Schema, text_column: int):  # noqa: ANN202
    """A function for mapInArrow: the statement over `batch`, in runs of rows of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                size = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0).cast(pa.int64()))
                bounds = pa.concat_arrays([pa.array([0], pa.int64()), size]).to_numpy()
                for a, b in blocks(bounds, RUN_BYTES):
                    con.register("batch", pa.Table.from_batches([batch.slice(a, b - a)]))
                    found = con.sql(statement, params=parameters).to_arrow_table()
                    con.unregister("batch")
                    yield from found.cast(pa.schema([pa.field(n, schema.field(i).type) for i, n in enumerate(found.schema.names)])).rename_columns(schema.names).combine_chunks().to_batches()

    return run


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """key, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output and restored."""
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names = [key, "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    schema = pa.schema(list(zip(names, [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)))
    run = _through_duckdb(_transform_sql(transformed, suffix_first), {"seed": seed}, schema, 1)
    given = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("body"))
    return given.mapInArrow(run, f"`{key}` {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """output, form and restored: the texts that fill_in_middle was given, from its output and form alone."""
    schema = pa.schema([(output, pa.string()), (form, pa.string()), ("restored", pa.string())])
    run = _through_duckdb(f"SELECT output, form, {RESTORE} AS restored FROM batch", {}, schema, 0)
    return df.select(F.col(f"`{output}`").alias("output"), F.col(f"`{form}`").alias("form")).mapInArrow(run, f"`{output}` string, `{form}` string, restored string")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {"op11_fill_middle": op11_fill_middle}
#: The parts by code points: the ends of the units are running sums of their lengths.
SQL = {
    "op11_fill_middle": """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), draws AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (len(u) + 1) AS b,
    CAST('0x' || h[17:24] AS UBIGINT) % 100 AS c, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS d FROM docs
), cuts AS (
  SELECT doc_id, t, n, coalesce(list_sum(list_transform(u[1:least(a, b)], lambda x: length(x))), 0) AS i, coalesce(list_sum(list_transform(u[1:greatest(a, b)], lambda x: length(x))), 0) AS j,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws
), parts AS (
  SELECT doc_id, t, n, form, i, j - i AS m, substr(t, 1, CAST(i AS BIGINT)) AS p, substr(t, CAST(i AS BIGINT) + 1, CAST(j - i AS BIGINT)) AS q, substr(t, CAST(j AS BIGINT) + 1) AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN i END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN m END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || q ELSE '<S>' || s || '<P>' || p || '<M>' || q END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
}
