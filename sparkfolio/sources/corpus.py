"""The domain model (papers, their entities, texts) as views over the star-schema test tables, in Spark and in SQL.

An investigation is a customer, a paper an order, an entity what its line items name. (l_orderkey, l_linenumber) repeats,
so bridges are distinct. Dimension tables are small, but nothing here says so: sizes decide about broadcasts at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What findings say, by the number of a part's brand.
FINDINGS = ["Accuracy rises with depth", "F1 and recall fall on long inputs", "BLEU, ROUGE and perplexity disagree", "The cost is moderate", "LATENCY: the latency halves"]

KINDS = ("author", "institution", "methodology", "dataset", "technology", "domain", "metric")


class Corpus:
    """Lazily read tables and views of a folder; each view selects only what it needs, so scans are pruned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def papers(self) -> DataFrame:
        """paper_id, investigation_id, year, citations, venue, created_at"""
        return self.table("orders").select(
            F.col("o_orderkey").alias("paper_id"),
            F.col("o_custkey").alias("investigation_id"),
            F.year("o_orderdate").cast("int").alias("year"),
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citations"),
            F.col("o_orderpriority").alias("venue"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    def _lines(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")

    def authors(self) -> DataFrame:
        """paper_id, name; distinct"""
        s = self.table("supplier").select("s_suppkey", F.col("s_name").alias("name"))
        return self._lines().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("paper_id", "name").distinct()

    def institutions(self) -> DataFrame:
        """paper_id, name; distinct"""
        s = self.table("supplier").select("s_suppkey", "s_nationkey")
        n = self.table("nation").select("n_nationkey", F.col("n_name").alias("name"))
        where = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "name")
        return self._lines().join(where, F.col("l_suppkey") == F.col("s_suppkey")).select("paper_id", "name").distinct()

    def of_parts(self, column: str) -> DataFrame:
        """paper_id, name for an attribute of parts: p_type methodology, p_brand dataset, p_name technology; distinct"""
        p = self.table("part").select("p_partkey", F.col(column).alias("name"))
        return self._lines().join(p, F.col("l_partkey") == F.col("p_partkey")).select("paper_id", "name").distinct()

    def methodologies(self) -> DataFrame:
        return self.of_parts("p_type")

    def datasets(self) -> DataFrame:
        return self.of_parts("p_brand")

    def technologies(self) -> DataFrame:
        return self.of_parts("p_name")

    def domains(self) -> DataFrame:
        return self.technologies().select("paper_id", F.substring_index("name", " ", -1).alias("name")).distinct()

    def metrics(self) -> DataFrame:
        return self._lines().select("paper_id", F.concat("l_returnflag", "l_linestatus").alias("name")).distinct()

    def mentions(self) -> DataFrame:
        """paper_id and the seven kinds of names that a line item mentions, a row a line item: one scan and one pass of joins for all kinds."""
        s = self.table("supplier").select("s_suppkey", F.col("s_name").alias("author"), "s_nationkey")
        n = self.table("nation").select("n_nationkey", F.col("n_name").alias("institution"))
        where = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "author", "institution")
        p = self.table("part").select("p_partkey", F.col("p_type").alias("methodology"), F.col("p_brand").alias("dataset"), F.col("p_name").alias("technology"), F.substring_index("p_name", " ", -1).alias("domain"))
        lines = self._lines().join(where, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
        return lines.select("paper_id", "author", "institution", "methodology", "dataset", "technology", "domain", F.concat("l_returnflag", "l_linestatus").alias("metric"))

    def entities(self) -> DataFrame:
        """paper_id, type, name over all seven kinds of entities; distinct, from a row a paper"""
        named = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("names")) for k in KINDS])
        return self.entity_sets(*KINDS).select("paper_id", F.explode(named).alias("e")).select("paper_id", "e.type", F.explode("e.names").alias("name"))

    def entity_sets(self, *kinds: str) -> DataFrame:
        """paper_id and for each kind the sorted array of its names: a row a paper, by one shuffle of the line items.

        Line items are dealt as they are: they are narrower than a row a name, and than sets of one name that would be merged."""
        lines = self.mentions().select("paper_id", F.struct(*kinds).alias("of")).repartition("paper_id")
        names = lambda k: F.sort_array(F.array_distinct(F.array_compact(F.col("of")[k])))
        return lines.groupBy("paper_id").agg(F.collect_list("of").alias("of")).select("paper_id", *[names(k).alias(k) for k in kinds])

    def findings(self) -> DataFrame:
        """investigation_id (the part's type), method, text, pos: a finding a line item, which speaks of metrics as its part's brand does."""
        p = self.table("part").select("p_partkey", F.col("p_type").alias("investigation_id"), F.col("p_brand").alias("method"), "p_size")
        spoken = F.element_at(F.array(*map(F.lit, FINDINGS)), (F.substring_index("method", "#", -1).cast("int") % len(FINDINGS) + 1).cast("int"))
        text = F.when(F.col("p_size") % 10 < 9, spoken).otherwise("No figures are given")
        lines = self.table("lineitem").select("l_partkey", F.col("l_orderkey").alias("pos"))
        return lines.join(p, F.col("l_partkey") == F.col("p_partkey")).select("investigation_id", "method", text.alias("text"), "pos")

    def raw_papers(self) -> DataFrame:
        """Paper-like records from documents, with collisions of DOI, title and URL on purpose."""
        d = self.table("documents").select("doc_id", "text", "source")
        k = F.col("doc_id")
        return d.select(
            k.alias("pos"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.when(k % 11 == 0, None).otherwise(F.col("text")).alias("abstract"),
            F.when(k % 5 == 0, F.concat(F.lit("10.1000/ABC."), (k % 400).cast("string"))).when(k % 7 == 0, F.lit("bad doi")).alias("doi"),
            F.when(k % 3 == 0, F.concat(F.lit("HTTPS://Example.org/p/"), (k % 500).cast("string"), F.lit("/"))).when(k % 13 == 0, F.lit("no-url")).alias("url"),
            (F.lit(1890) + k % 140).cast("int").alias("year"),
            (k % 97 - 3).cast("int").alias("citations"),
            F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Venue "), (k % 9).cast("string"))).alias("venue"),
            F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Author "), (k % 50).cast("string")))).alias("authors"),
            F.element_at(F.array(F.lit("semantic_scholar"), F.lit("openalex"), F.lit("arxiv"), F.lit("other")), (k % 4 + 1).cast("int")).alias("source"),
        )


VIEWS = {
    "papers": "SELECT o_orderkey AS paper_id, o_custkey AS investigation_id, year(o_orderdate)::INT AS year, floor(o_totalprice / 1000)::INT AS citations, o_orderpriority AS venue, o_orderdate AS created_at FROM orders",
    "authors": "SELECT DISTINCT l_orderkey AS paper_id, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "institutions": "SELECT DISTINCT l_orderkey AS paper_id, n_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "methodologies": "SELECT DISTINCT l_orderkey AS paper_id, p_type AS name FROM lineitem JOIN part ON l_partkey = p_partkey",
    "datasets": "SELECT DISTINCT l_orderkey AS paper_id, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey",
    "technologies": "SELECT DISTINCT l_orderkey AS paper_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey",
    "domains": "SELECT DISTINCT paper_id, split_part(name, ' ', -1) AS name FROM technologies",
    "metrics": "SELECT DISTINCT l_orderkey AS paper_id, l_returnflag || l_linestatus AS name FROM lineitem",
    "entities": " UNION ALL ".join(
        f"SELECT paper_id, '{k}' AS type, name FROM {v}"
        for k, v in [("author", "authors"), ("institution", "institutions"), ("methodology", "methodologies"), ("dataset", "datasets"), ("technology", "technologies"), ("domain", "domains"), ("metric", "metrics")]
    ),
    "findings": "SELECT p_type AS investigation_id, p_brand AS method, CASE WHEN p_size % 10 < 9 THEN ['" + "', '".join(FINDINGS) + "'][split_part(p_brand, '#', 2)::INT % 5 + 1] ELSE 'No figures are given' END AS text, l_orderkey AS pos FROM lineitem JOIN part ON l_partkey = p_partkey",
    "raw_papers": """SELECT doc_id AS pos, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS abstract,
        CASE WHEN doc_id % 5 = 0 THEN '10.1000/ABC.' || (doc_id % 400) WHEN doc_id % 7 = 0 THEN 'bad doi' END AS doi,
        CASE WHEN doc_id % 3 = 0 THEN 'HTTPS://Example.org/p/' || (doc_id % 500) || '/' WHEN doc_id % 13 = 0 THEN 'no-url' END AS url,
        (1890 + doc_id % 140)::INT AS year, (doc_id % 97 - 3)::INT AS citations, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Venue ' || (doc_id % 9) END AS venue,
        CASE WHEN doc_id % 6 = 0 THEN []::VARCHAR[] ELSE ['Author ' || (doc_id % 50)] END AS authors,
        ['semantic_scholar', 'openalex', 'arxiv', 'other'][(doc_id % 4 + 1)::INT] AS source FROM documents""",
}
NEEDS = {"domains": ["technologies"], "entities": ["authors", "institutions", "methodologies", "datasets", "technologies", "domains", "metrics"]}


def sql(views: str, body: str) -> str:
    """body with the named views (and those that they need) as common table expressions. A body may go on with its own."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in sorted(names, key=list(VIEWS).index))
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"WITH {ctes} {body}"
