"""Fill-in-the-middle documents: SQL of an embedded database over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import parts_of, ship, text_of

#: Units that a text is cut between; what marks the three pieces of an output.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many stay as they are, and how many of the rest have the suffix in front.
PLAIN_PERCENT, SPM_PERCENT, SEED = 10, 20, 1


def transform_sql(seed: int, plain: int, spm: int) -> str:
    """SQL over batch (doc_id, text): the units of every text, two cuts between them by a digest of doc_id, the output."""
    word = "('0x' || substr(h, {}, 8))::BIGINT"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM batch),
    u AS (SELECT *, regexp_extract_all(text, '{UNIT}') AS units FROM d),
    c AS (SELECT *, len(units) AS n, {word.format(1)} % (len(units) + 1) AS one, {word.format(9)} % (len(units) + 1) AS two,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {word.format(17)} % 100 >= {100 - plain} THEN 'plain'
            WHEN {word.format(25)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, least(one, two)), '') AS prefix,
        array_to_string(list_slice(units, least(one, two) + 1, greatest(one, two)), '') AS middle, array_to_string(list_slice(units, greatest(one, two) + 1, n), '') AS suffix FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
    FROM p"""


#: The text of an output. A piece holds no mark, and no mark arises where a piece and a mark meet: a mark has its "<" only in
#: front and its ">" only at its end.
RESTORE_SQL = f"""
    WITH s AS (SELECT *, string_split(output, '{MIDDLE}') AS halves FROM batch),
    q AS (SELECT *, string_split(substr(halves[1], 4), CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS ends FROM s)
    SELECT * EXCLUDE (halves, ends), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN ends[1] || halves[2] || ends[2] ELSE ends[2] || halves[2] || ends[1] END AS restored
    FROM q"""


def through_sql(df: DataFrame, sql: str, schema: T.StructType) -> DataFrame:
    """What the SQL gives for each batch of df, as the view batch; a connection a task, of one thread, in memory."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for part in parts_of(batches):
                con.register("batch", pa.Table.from_batches([part]))
                yield from con.execute(sql).to_arrow_table().cast(arrow).to_batches()
                con.unregister("batch")

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: every text with its middle moved to the end, a row per row of docs.

    A text is cut between units (runs of ASCII letters, single other characters; n of them) at two places that a digest of
    the seed and doc_id picks, so that a document has the same output wherever and with whatever it is processed. form is
    psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain (the text itself: plain_percent of the documents, empty
    texts and those that hold one of the marks). Lengths are in code points, null if plain.

    Null texts count as empty, a null doc_id as no digits; repeated rows give equal rows, an empty table none; a very long text is one
    row like any other, its units held in its task (16 bytes each, twice). Columns other than doc_id and text are not read.
    No shuffle.
    """
    ship(docs.sparkSession)
    schema = T._parse_datatype_string("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return through_sql(text_of(docs), transform_sql(seed, plain_percent, spm_percent), schema)


def restore_texts(outputs: DataFrame) -> DataFrame:
    """outputs (with form and output) with the text restored at its end, rebuilt from these two alone; null if either is null."""
    ship(outputs.sparkSession)
    return through_sql(outputs, RESTORE_SQL, T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())]))


def infill_digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle() and restore_texts() with SHA-256 (of UTF-8) in place of the texts. Rows are as there."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore_texts(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


#: The same by positions in the text instead of joined lists.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
w AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]')) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
k AS (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS lens FROM f),
s AS (SELECT *, coalesce(list_sum(lens[:a]), 0)::BIGINT AS pc, coalesce(list_sum(lens[:b]), 0)::BIGINT AS mc FROM k),
o AS (SELECT *, substr(text, 1, pc) AS p, substr(text, pc + 1, mc - pc) AS m, substr(text, mc + 1) AS s FROM s)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN pc END AS prefix_chars, CASE WHEN form <> 'plain' THEN mc - pc END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
