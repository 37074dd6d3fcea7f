"""The publication graph that the driver's tables stand for.

Orders are papers, parts are topics (brand and type above them), customers are authors, suppliers are
affiliations.  ``Graph`` builds each table in Spark; ``PRELUDE`` states the same tables as SQL.

Every table is a plan over the given tables: nothing is written, and a query reads the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.operators import indicators, topics
from citegraph.session import materialise

YEAR = "1996"
PAPERS = 10

# Authorships whose links one task holds.
LINKS_PER_TASK = 250_000

# Fragments that read the same in Spark SQL and DuckDB.
COUNTRY = """case n_nationkey when 0 then 'Egypt' when 1 then 'Taiwan' when 2 then 'South Korea'
    when 3 then 'United States' when 4 then 'India' when 5 then 'Czechia' when 6 then 'Russia'
    when 7 then 'Iran' else n_name end"""
PLACE_COUNTRY = f"""case when s_suppkey % 10 = 7 then '' when s_suppkey % 10 = 9 then null
    else {COUNTRY} end"""
AFFILIATION_NAME = """concat(case s_suppkey % 5 when 0 then 'university of ' when 1 then 'institute of '
    when 2 then 'general hospital of ' when 3 then 'holdings of ' else 'engineering works of ' end,
    lower(n_name), ' ', cast(s_suppkey as varchar(20)))"""
AUTHOR_NAME = """concat(case c_custkey % 8
    when 0 then concat(substr(c_mktsegment, 1, 4), ' ')
    when 1 then 'A. '
    when 2 then concat(c_mktsegment, ' B. ')
    when 3 then concat('(', c_mktsegment, ') ')
    when 4 then concat(c_mktsegment, '--', substr(c_mktsegment, 1, 3), ' ')
    when 5 then concat('A-B ', c_mktsegment, ' ')
    when 6 then concat(c_mktsegment, '-J ')
    else '' end, 'Surname', cast(c_nationkey as varchar(20)))"""
JOURNAL_NAME = """case o_custkey % 50 when 0 then 'biorxiv' when 1 then 'medrxiv' when 2 then 'arxiv optics'
    when 3 then 'arxiv' else concat('journal ', cast(o_custkey % 50 as varchar(20))) end"""
GENDER = "case when c_custkey % 5 in (0, 1) then 'female' when c_custkey % 5 = 4 then 'unknown' else 'male' end"


def holdable(build: Callable[[Graph], DataFrame]) -> property:
    """A table that ``Graph.hold`` may store for the rest of a query."""
    name = build.__name__
    return property(lambda self: self._held[name] if name in self._held else build(self), doc=build.__doc__)


class Graph:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._held: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}
        self._partitions: int | None = None

    def hold(self, *names: str) -> Graph:
        """Store tables that several parts of one query share; the others stay plans."""
        for name in names:
            self._held[name] = materialise(getattr(self, name))
        return self

    def table(self, name: str) -> DataFrame:
        """A given table; its files are looked up once for a query."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @property
    def documents(self) -> DataFrame:
        """The documents; a file that is read by fewer tasks than there are cores is dealt out first.

        Work on whole texts is costly per row, and the given file is one row group, which is one task.  A table with
        files enough for all cores is not shuffled.
        """
        return self.dealt_out(self.table("documents"))

    def dealt_out(self, table: DataFrame) -> DataFrame:
        """Rows that cost much each, by as many tasks as there are cores."""
        cores = self.spark.sparkContext.defaultParallelism
        return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table

    def dealt(self, links: DataFrame, *keys: str) -> DataFrame:
        """Links by key, over so many partitions that what one task holds does not grow with the tables.

        Grouping and joining by the key, alone or with other columns, needs no second shuffle.
        """
        if self._partitions is None:
            session = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._partitions = max(session, -(-self.table("lineitem").count() // LINKS_PER_TASK))
        return links.repartition(self._partitions, *keys)

    def size(self, name: str) -> Column:
        """The number of rows of a table, found when the query runs."""
        return self.table(name).agg(F.count(F.lit(1))).scalar()

    # --- graph tables ---------------------------------------------------------------------------------
    @property
    def papers(self) -> DataFrame:
        """Papers with their abstracts; queries that need no text use ``paper_attributes``."""
        documents = self.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"))
        return self.paper_attributes.join(documents, "id", "left")

    @property
    def paper_attributes(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.year("o_orderdate").cast("string").alias("year"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citations"),
            F.concat(F.lit("Paper "), F.col("o_orderkey").cast("string")).alias("original_title"),
        )

    @property
    def _tags(self) -> DataFrame:
        parts = self.table("part").select("p_partkey", self._brand.alias("brand"))
        return self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(
            parts, "p_partkey"
        )

    @property
    def _brand(self):
        return F.substring("p_brand", 7, 9).cast("long")

    @property
    def _type_ids(self) -> DataFrame:
        """The part types, numbered in name order; there is only a handful of them."""
        types = self.table("part").select("p_type").distinct()
        return types.select("p_type", F.expr("900 + dense_rank() over (order by p_type)").cast("long").alias("type"))

    @property
    def fields_of_study(self) -> DataFrame:
        return self._levels.select("id", "name")

    @property
    def _levels(self) -> DataFrame:
        part = self.table("part")
        low = part.select((F.col("p_partkey") + 1000).alias("id"), F.col("p_name").alias("name"), F.lit(2).alias("level"))
        mid = part.select(self._brand.alias("id"), F.col("p_brand").alias("name"), F.lit(1).alias("level")).distinct()
        top = self._type_ids.select(F.col("type").alias("id"), F.col("p_type").alias("name"), F.lit(0).alias("level"))
        return low.unionByName(mid).unionByName(top)

    @holdable
    def paper_fos(self) -> DataFrame:
        brand = self._tags.select(F.col("l_orderkey").alias("paper_id"), F.col("brand").alias("field_of_study_id"))
        part = self._tags.select(
            F.col("l_orderkey").alias("paper_id"), (F.col("p_partkey") + 1000).alias("field_of_study_id")
        )
        return brand.unionByName(part).distinct()

    @property
    def topic_links(self) -> DataFrame:
        """The rows of ``paper_fos`` as often as they occur."""
        ids = F.explode(F.array("brand", F.col("p_partkey") + 1000))
        return self._tags.select(F.col("l_orderkey").alias("paper_id"), ids.alias("field_of_study_id"))

    def authorship_links(self, *columns: str) -> DataFrame:
        """Columns of the authorships, as often as they occur."""
        return self._authorship.select(*columns)

    @property
    def used_topics(self) -> DataFrame:
        """The topics that some paper carries, once each: for what only asks whether there is a link."""
        used = self.table("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
        parts = used.join(self.table("part").select("p_partkey", self._brand.alias("brand")), "p_partkey")
        ids = F.explode(F.array("brand", F.col("p_partkey") + 1000))
        return parts.select(ids.alias("field_of_study_id")).distinct()

    @property
    def published_authors(self) -> DataFrame:
        """The authors of some paper, once each."""
        return self._authorship.select("author_id").distinct()

    @property
    def edges(self) -> DataFrame:
        part = self.table("part")
        down = part.select(self._brand.alias("parent"), (F.col("p_partkey") + 1000).alias("child"))
        top = part.join(self._type_ids, "p_type").select(F.col("type").alias("parent"), self._brand.alias("child"))
        return down.unionByName(top).distinct()

    @property
    def hierarchy(self) -> DataFrame:
        """id, child_id: a part has an empty list."""
        children = self.edges.groupBy(F.col("parent").alias("id")).agg(F.collect_list("child").alias("child_id"))
        empty = F.array().cast("array<long>")
        return self._levels.select("id").join(children, "id", "left").select(
            "id", F.coalesce("child_id", empty).alias("child_id")
        )

    @property
    def metadata(self) -> DataFrame:
        return self._levels.select("id", "level", F.lit(None).cast("long").alias("frequency"))

    @holdable
    def author_affiliation(self) -> DataFrame:
        return self._authorship.select("affiliation_id", "author_id", "paper_id").distinct()

    @property
    def affiliation_links(self) -> DataFrame:
        """(paper_id, affiliation_id) of the authorships, as often as they occur: for what only asks whether there is one."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("affiliation_id"))

    @property
    def _authorship(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("affiliation_id"),
            (F.col("l_partkey") % self.size("customer")).alias("author_id"),
            F.col("l_orderkey").alias("paper_id"),
            "l_linenumber",
        )

    @property
    def paper_authors(self) -> DataFrame:
        return self.dealt(self._authorship, "paper_id").groupBy("paper_id", "author_id").agg(F.min("l_linenumber").alias("order"))

    @property
    def affiliation(self) -> DataFrame:
        return self._suppliers.select(
            F.col("s_suppkey").alias("id"), F.expr(AFFILIATION_NAME).alias("affiliation")
        )

    @property
    def _suppliers(self) -> DataFrame:
        nation = self.table("nation").withColumnRenamed("n_nationkey", "s_nationkey")
        return self.table("supplier").join(nation, "s_nationkey").withColumn("n_nationkey", F.col("s_nationkey"))

    @property
    def places(self) -> DataFrame:
        return self._suppliers.select(
            F.col("s_suppkey").alias("affiliation_id"), F.expr(PLACE_COUNTRY).alias("country")
        )

    @property
    def authors(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.expr(AUTHOR_NAME).alias("name"))

    @property
    def gender(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.expr(GENDER).alias("gender"),
            ((F.col("c_custkey") % 101) / 100).cast("double").alias("probability"),
        )

    @property
    def journals(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_custkey") % 50).alias("id"),
            F.expr(JOURNAL_NAME).alias("journal_name"),
            F.col("o_orderkey").alias("paper_id"),
        )

    @property
    def vectors(self) -> DataFrame:
        embeddings = self.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % self.size("embeddings")).alias("vec_id")
        )
        return orders.join(embeddings, "vec_id").select("id", "vector")

    @property
    def country_values(self) -> DataFrame:
        """country, year, value: turnover of each nation's customers as a stand-in for an indicator."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_nationkey", "n_name")
        customers = self.table("customer").join(nation, "c_nationkey").select(
            F.col("c_custkey").alias("o_custkey"), F.expr(COUNTRY).alias("country")
        )
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        return (
            self.table("orders")
            .select("o_custkey", F.year("o_orderdate").cast("string").alias("year"), cents.alias("cents"))
            .join(customers, "o_custkey")
            .groupBy("country", "year")
            .agg((F.sum("cents") / 100.0).alias("value"))
        )

    # --- derived and stored ---------------------------------------------------------------------------
    @property
    def frequencies(self) -> DataFrame:
        return topics.topic_frequency(self.paper_fos, self.metadata)

    @holdable
    def paper_countries(self) -> DataFrame:
        """Distinct (paper_id, country), the base of every country indicator."""
        return indicators.paper_entities(self.places, self.affiliation_links)

    @holdable
    def filtered(self) -> DataFrame:
        return topics.filter_topics(self.frequencies)

    @holdable
    def closure(self) -> DataFrame:
        return topics.topic_closure(self.hierarchy, self.filtered)

    # --- landed records -------------------------------------------------------------------------------
    @property
    def raw(self) -> DataFrame:
        """Landed publication records with ``ordinal`` = order key."""
        return self.landed(people=True, topics=True, texts=True)

    def landed(self, people: bool = False, topics: bool = False, texts: bool = False) -> DataFrame:
        """The records with the chosen nested parts."""
        records = self.table("orders")
        key = F.col("o_orderkey")
        if people:
            records = records.join(self._people, "o_orderkey", "left")
        if topics:
            records = records.join(self._topics, "o_orderkey", "left")
        if texts:
            # A text travels to its record as it is: its words and positions take several times as much.
            indexed = self._indexed(self.table("documents").select("doc_id", "text").repartition("doc_id"))
            records = records.join(indexed.withColumnRenamed("id", "o_orderkey"), "o_orderkey", "left")
        numbers = lambda n: F.concat(F.lit(n), key.cast("string"))
        journal = F.struct(F.expr(JOURNAL_NAME).alias("JN"), (F.col("o_custkey") % 50).alias("JId"))
        conference = F.struct(
            F.concat(F.lit("conference "), F.col("o_orderpriority")).alias("CN"),
            (F.col("o_custkey") % 7).alias("CId"),
        )
        link = F.struct(F.lit(1).alias("Ty"), numbers("https://example.org/paper/").alias("U"))
        return records.select(
            key.alias("Id"),
            F.concat_ws(" ", F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("Ti"),
            F.col("o_orderstatus").alias("Pt"),
            numbers("Paper ").alias("DN"),
            F.year("o_orderdate").alias("Y"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("D"),
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("CC"),
            F.lit(1.0).alias("prob"),
            F.col("o_totalprice").alias("logprob"),
            F.when(F.col("o_orderstatus") == "F", numbers("10.1000/")).alias("DOI"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("PB"),
            F.lit("a").alias("BT"),
            F.when(key > 1, F.array(key - 1, key - 2)).alias("RId"),
            *([F.coalesce("AA", F.array()).alias("AA")] if people else []),
            *(["F"] if topics else []),
            F.when(F.col("o_orderstatus") != "O", journal).alias("J"),
            F.when(F.col("o_orderstatus") == "O", conference).alias("C"),
            *(["IA"] if texts else []),
            F.when(F.col("o_orderstatus") != "P", F.array(link)).alias("S"),
            key.alias("ordinal"),
        )

    @property
    def _people(self) -> DataFrame:
        authors = self.authors.select(F.col("id").alias("author_id"), "name")
        affiliations = self.affiliation.select(F.col("id").alias("affiliation_id"), "affiliation")
        author = F.struct(
            F.col("l_linenumber").alias("_line"),
            F.struct(
                F.col("name").alias("DAuN"),
                F.col("author_id").alias("AuId"),
                F.col("affiliation").alias("AfN"),
                F.col("affiliation_id").alias("AfId"),
                F.col("l_linenumber").alias("S"),
            ).alias("a"),
        )
        return (
            self._authorship.join(authors, "author_id").join(affiliations, "affiliation_id", "left")
            # Plain rows travel; lists of nested ones, of which a task has few of each paper, would be larger.
            .withColumnRenamed("paper_id", "o_orderkey").repartition("o_orderkey")
            .groupBy("o_orderkey")
            .agg(F.sort_array(F.collect_list(author)).alias("people"))
            .select("o_orderkey", F.transform("people", lambda p: p["a"]).alias("AA"))
        )

    @property
    def _topics(self) -> DataFrame:
        """The distinct topics of each paper.  Those of a part get their names once, before its links to papers meet them."""
        names = self.fields_of_study.select(F.col("id").alias("field_of_study_id"), "name")
        topic = F.struct(F.col("name").alias("DFN"), F.col("field_of_study_id").alias("FId"))
        ids = F.explode(F.array(self._brand, F.col("p_partkey") + 1000)).alias("field_of_study_id")
        named = (
            self.table("part").select("p_partkey", ids).join(names, "field_of_study_id")
            .groupBy("p_partkey").agg(F.collect_set(topic).alias("topics"))
        )
        links = self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
        return (
            links.join(named, "p_partkey").select("o_orderkey", "topics").repartition("o_orderkey")
            .groupBy("o_orderkey")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("F"))
        )

    @property
    def inverted_index(self) -> DataFrame:
        """id, IA: every document as a word -> positions map, built inside its row."""
        return self._indexed(self.documents)

    def _indexed(self, documents: DataFrame) -> DataFrame:
        words = F.split("text", " ", -1)
        # sort_array compares whole structs; array_sort would call its comparison lambda for every pair of words.
        placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("position"))))

        def index(pairs):
            word = lambda i: F.get(pairs, i)["word"]
            starts = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (i == 0) | (word(i) != word(i - 1)))
            entry = lambda s: F.transform(
                s,
                lambda p, i: F.struct(
                    word(p).alias("key"),
                    F.transform(
                        F.slice(pairs, p + 1, F.coalesce(F.get(s, i + 1), F.size(pairs)) - p), lambda x: x["position"]
                    ).alias("value"),
                ),
            )
            # A list of one element binds a value to a name, so that it is computed once.
            entries = F.get(F.transform(F.array(starts), entry), F.lit(0))
            return F.struct(F.size(pairs).alias("IndexLength"), F.map_from_entries(entries).alias("InvertedIndex"))

        documents = documents.filter(F.col("text").isNotNull())
        return documents.select(F.col("doc_id").alias("id"), F.get(F.transform(F.array(placed), index), F.lit(0)).alias("IA"))


PRELUDE = f"""
WITH RECURSIVE
papers AS (
    SELECT o_orderkey AS id, cast(year(o_orderdate) AS varchar) AS year,
        strftime(o_orderdate, '%Y-%m-%d') AS date, cast(floor(o_totalprice / 1000) AS integer) AS citations,
        concat('Paper ', cast(o_orderkey AS varchar)) AS original_title, text AS abstract
    FROM orders LEFT JOIN documents ON doc_id = o_orderkey),
brands AS (SELECT p_partkey, p_name, p_type, p_brand, cast(substr(p_brand, 7) AS bigint) AS brand FROM part),
type_ids AS (
    SELECT p_type, 900 + dense_rank() OVER (ORDER BY p_type) AS type FROM (SELECT DISTINCT p_type FROM part)),
levels AS (
    SELECT p_partkey + 1000 AS id, p_name AS name, 2 AS level FROM part
    UNION ALL SELECT DISTINCT brand, p_brand, 1 FROM brands
    UNION ALL SELECT type, p_type, 0 FROM type_ids),
paper_fos AS (
    SELECT l_orderkey AS paper_id, brand AS field_of_study_id FROM lineitem JOIN brands ON p_partkey = l_partkey
    UNION SELECT l_orderkey, l_partkey + 1000 FROM lineitem JOIN brands ON p_partkey = l_partkey),
edges AS (
    SELECT brand AS parent, p_partkey + 1000 AS child FROM brands
    UNION SELECT type, brand FROM brands JOIN type_ids USING (p_type)),
authorship AS (
    SELECT l_suppkey AS affiliation_id, l_partkey % (SELECT count(*) FROM customer) AS author_id,
        l_orderkey AS paper_id, l_linenumber FROM lineitem),
author_affiliation AS (SELECT DISTINCT affiliation_id, author_id, paper_id FROM authorship),
paper_authors AS (SELECT paper_id, author_id, min(l_linenumber) AS "order" FROM authorship GROUP BY ALL),
suppliers AS (SELECT * FROM supplier JOIN nation ON n_nationkey = s_nationkey),
affiliation AS (SELECT s_suppkey AS id, {AFFILIATION_NAME} AS affiliation FROM suppliers),
places AS (SELECT s_suppkey AS affiliation_id, {PLACE_COUNTRY} AS country FROM suppliers),
authors AS (SELECT c_custkey AS id, {AUTHOR_NAME} AS name FROM customer),
gender AS (
    SELECT c_custkey AS id, {GENDER} AS gender, cast((c_custkey % 101) / 100.0 AS double) AS probability
    FROM customer),
journals AS (SELECT o_custkey % 50 AS id, {JOURNAL_NAME} AS journal_name, o_orderkey AS paper_id FROM orders),
vectors AS (
    SELECT id, embedding AS vector FROM (
        SELECT o_orderkey AS id, o_orderkey % (SELECT count(*) FROM embeddings) AS vec_id FROM orders)
    JOIN embeddings USING (vec_id)),
country_values AS (
    SELECT {COUNTRY} AS country, cast(year(o_orderdate) AS varchar) AS year,
        sum(cast(round(o_totalprice * 100) AS bigint)) / 100.0 AS value
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
frequency AS (SELECT field_of_study_id AS id, count(*) AS n FROM paper_fos GROUP BY 1),
metadata AS (SELECT id, level, cast(n AS bigint) AS frequency FROM levels LEFT JOIN frequency USING (id)),
thresholds AS (
    SELECT level, cast(floor(quantile_cont(frequency, 0.75)) AS bigint) AS threshold FROM metadata GROUP BY 1),
filtered AS (
    SELECT level, id AS field_of_study_id FROM metadata JOIN thresholds USING (level)
    WHERE level = 1 AND frequency > threshold),
reach AS (
    SELECT field_of_study_id AS topic, field_of_study_id AS descendant, 0 AS hop FROM filtered
    UNION SELECT topic, child, hop + 1 FROM reach JOIN edges ON parent = descendant WHERE hop < 5),
closure AS (SELECT DISTINCT topic, descendant FROM reach),
topic_papers AS (
    SELECT DISTINCT topic, paper_id FROM closure JOIN paper_fos ON field_of_study_id = descendant),
paper_country AS (
    SELECT DISTINCT paper_id, country FROM author_affiliation JOIN places USING (affiliation_id)
    WHERE country IS DISTINCT FROM ''),
fact AS (
    SELECT f.field_of_study_id, country, paper_id, citations, year
    FROM paper_country JOIN papers ON id = paper_id JOIN paper_fos f USING (paper_id)
    WHERE f.field_of_study_id IN (SELECT field_of_study_id FROM filtered))
"""
