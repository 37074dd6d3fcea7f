"""Topic frequency, selection, descendants and yearly totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import config
from citegraph.session import materialise

# Links of the hierarchy whose pairs one task of the closure holds.
LINKS_PER_TASK = 250_000


def topic_frequency(paper_fos: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata with ``frequency`` = number of links; topics without a link keep their old value."""
    counts = paper_fos.groupBy(F.col("field_of_study_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_links")
    )
    return metadata.join(counts, "id", "left").select(
        "id", "level", F.coalesce("_links", "frequency").alias("frequency")
    )


def filter_topics(
    metadata: DataFrame,
    levels: Sequence[int] = config.TOPIC_LEVELS,
    percentiles: Sequence[float] = config.TOPIC_PERCENTILES,
) -> DataFrame:
    """Topics of each level that are more frequent than the (truncated) percentile of their level.

    The exact percentile keeps one counter per distinct frequency, and d distinct frequencies need at
    least d*d/2 links, so its state stays small however many links there are.
    """
    chosen = dict(zip(levels, percentiles))
    if not chosen:
        raise ValueError("at least one level is needed")
    per_level = metadata.filter(F.col("level").isin(list(chosen)))
    cuts = [
        F.percentile(F.when(F.col("level") == level, F.col("frequency")), percentile / 100.0)
        for level, percentile in chosen.items()
    ]
    threshold = per_level.groupBy("level").agg(F.coalesce(*cuts).cast("long").alias("_threshold"))
    return (
        per_level.join(F.broadcast(threshold), "level")  # one row per level
        .filter(F.col("frequency") > F.col("_threshold"))
        .select("level", F.col("id").alias("field_of_study_id"))
    )


def topic_closure(
    hierarchy: DataFrame, topics: DataFrame, max_hops: int = config.CLOSURE_HOPS
) -> DataFrame:
    """(field_of_study_id, descendant): each topic itself and what is reachable in ``max_hops`` steps.

    Every pass joins the pairs to their lists of children and keeps both ends, with duplicates removed, so a
    cycle or self-loop adds nothing and a topic without links stays as it is.  The pairs occur once per
    pass, so the plan grows linearly; the lists, which every pass reads, are stored once.  A few pairs may lead
    to very many, so the tasks that remove duplicates are counted by links, not by the bytes that are shuffled.
    """
    listed = hierarchy.select(F.col("id").alias("descendant"), F.array_compact("child_id").alias("_children"))
    listed = materialise(listed.filter(F.size("_children") > 0))
    links = listed.agg(F.sum(F.size("_children")).alias("n")).first()["n"] or 0
    tasks = max(1, -(-links // LINKS_PER_TASK), min(listed.sparkSession.sparkContext.defaultParallelism, links))
    root = topics.select(F.col("field_of_study_id")).distinct()
    pairs = root.withColumn("descendant", F.col("field_of_study_id"))
    for _ in range(max_hops):
        reached = F.concat(F.array("descendant"), F.coalesce("_children", F.array()))
        pairs = (
            pairs.join(listed, "descendant", "left")
            .select("field_of_study_id", F.explode(reached).alias("descendant"))
            .repartition(tasks, "field_of_study_id", "descendant")
            .distinct()
        )
    return pairs


def topic_papers(paper_fos: DataFrame, closure: DataFrame) -> DataFrame:
    """Distinct (field_of_study_id, paper_id) for papers tagged with the topic or any descendant."""
    links = paper_fos.select("paper_id", F.col("field_of_study_id").alias("descendant"))
    return links.join(closure, "descendant").select("field_of_study_id", "paper_id").distinct()


def all_children(closure: DataFrame) -> DataFrame:
    """The closure as one sorted array per topic; the number of topics bounds its length."""
    return closure.groupBy("field_of_study_id").agg(
        F.sort_array(F.collect_list("descendant")).alias("all_children")
    )


def yearly_topic_totals(papers: DataFrame, paper_fos: DataFrame, closure: DataFrame) -> DataFrame:
    """Per topic and year: number of papers under the topic and the sum of their citations."""
    dated = papers.filter(F.col("year").isNotNull()).select(
        F.col("id").alias("paper_id"), "year", "citations"
    )
    links = paper_fos.select("paper_id", F.col("field_of_study_id").alias("descendant"))
    # Year and citations join first: the rows are then partitioned by paper, which the distinct on
    # (topic, paper) can use as it is when the closure is small enough to be broadcast.
    totals = (
        links.join(dated, "paper_id")
        .join(closure, "descendant")
        .select("paper_id", "field_of_study_id", "year", "citations")
        .distinct()
        .groupBy("field_of_study_id", "year")
        .agg(
            F.count(F.lit(1)).alias("paper_count"),
            F.coalesce(F.sum("citations"), F.lit(0)).alias("total_citations"),
        )
    )
    return totals.join(all_children(closure), "field_of_study_id").select(
        "field_of_study_id", "all_children", "year", "paper_count", "total_citations"
    )
