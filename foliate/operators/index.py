"""The chunk index: change detection, synchronisation, and summaries of what is indexed."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .providers import embed

#: Tokens that the embedding model takes, and the characters of one where no tokenizer is at hand.
TOKEN_LIMIT = 8192
TOKEN_CHARACTERS = 4
#: Folders of a written index.
BUCKETS = 256
IDENTITY = ("content_hash", "embedding_model", "embedding_revision", "embedding_config_hash", "embedding_dimension")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def space_hash(settings: dict) -> str:
    """Identity of an embedding space: hash of its settings in canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def with_identity(chunks: DataFrame, model: str, revision: str, config_hash: str, dimension: int) -> DataFrame:
    return chunks.withColumn("content_hash", content_hash(F.col("text"))).withColumn("embedding_model", F.lit(model)).withColumn("embedding_revision", F.lit(revision)).withColumn("embedding_config_hash", F.lit(config_hash)).withColumn("embedding_dimension", F.lit(dimension))


def in_space(chunks: DataFrame, model: str, revision: str, config_hash: str, dimension: int) -> DataFrame:
    """The chunks whose vectors lie in one embedding space; vectors of other generations are not comparable."""
    mine = (F.col("embedding_model") == model) & (F.col("embedding_revision") == revision) & (F.col("embedding_config_hash") == config_hash) & (F.col("embedding_dimension") == dimension)
    return chunks.where(mine)


def over_limit(df: DataFrame, text: str = "text", limit: int = TOKEN_LIMIT, tokens: Column | None = None) -> DataFrame:
    """Adds ``over_limit``: whether a text has more tokens than the model takes. ``tokens`` counts them; by default, a
    token stands for ``TOKEN_CHARACTERS`` characters. Null texts are within the limit."""
    count = F.ceil(F.length(text) / TOKEN_CHARACTERS) if tokens is None else tokens
    return df.withColumn("over_limit", F.coalesce(count > limit, F.lit(False)))


def require_within_limit(df: DataFrame, text: str = "text", limit: int = TOKEN_LIMIT, tokens: Column | None = None) -> DataFrame:
    """The rows as they are; fails when a text above the limit is read. Nothing is cut."""
    checked = over_limit(df, text, limit, tokens)
    return checked.withColumn(text, F.when(F.col("over_limit"), F.raise_error(F.lit(f"a text has more than {limit} tokens"))).otherwise(F.col(text))).drop("over_limit")


def input_problems(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, problem): ids that occur more than once, and chunks of documents that are not being indexed."""
    repeated = repeated_keys(chunks, "chunk_id").select("chunk_id", F.lit("repeated_id").alias("problem"))
    foreign = chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti").select("chunk_id", F.lit("foreign_document").alias("problem")).distinct()
    return repeated.unionByName(foreign)


def document(catalog: DataFrame, document_id: str) -> DataFrame:
    """The catalog row of one document: one or none."""
    return catalog.where(F.col("document_id") == document_id).limit(1)


def parsed_json(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, parsed_document_json) of the asked-for documents: the record received last, null if there is none."""
    last = records.groupBy("document_id").agg(F.max_by("parsed_document_json", F.struct("received_at", "record_no")).alias("parsed_document_json"))
    return documents.select("document_id").distinct().join(last, "document_id", "left")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(``key``, rows) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def plan_sync(incoming: DataFrame, stored: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """(document_id, chunk_id, action): insert, update (identity changed), refresh (unchanged) or delete.

    Only documents that occur in ``incoming`` are synchronised; rows of others are left alone. One full outer join.
    """
    old = stored.join(incoming.select("document_id").distinct(), "document_id", "left_semi")
    a = incoming.select("chunk_id", F.col("document_id").alias("d_new"), *[F.col(c).alias(f"{c}_new") for c in identity])
    b = old.select("chunk_id", F.col("document_id").alias("d_old"), *[F.col(c).alias(f"{c}_old") for c in identity])
    same = F.lit(True)
    for c in identity:
        same = same & F.equal_null(f"{c}_new", f"{c}_old")
    action = F.when(F.col("d_old").isNull(), "insert").when(F.col("d_new").isNull(), "delete").when(same, "refresh").otherwise("update")
    return a.join(b, "chunk_id", "full_outer").select(F.coalesce("d_new", "d_old").alias("document_id"), "chunk_id", action.alias("action"))


def sync_counts(plan: DataFrame) -> DataFrame:
    """(document_id, inserted, updated, refreshed, deleted) of a plan."""
    n = lambda name: F.count_if(F.col("action") == name)
    return plan.groupBy("document_id").agg(n("insert").alias("inserted"), n("update").alias("updated"), n("refresh").alias("refreshed"), n("delete").alias("deleted"))


def synchronise(incoming: DataFrame, stored: DataFrame, embedder: str = "hashed") -> DataFrame:
    """The index after synchronisation. Only new and changed texts are embedded; unchanged ones keep their vector but
    take the new metadata; rows of other documents stay."""
    plan = plan_sync(incoming, stored).select("chunk_id", "action")
    fresh = incoming.join(plan.where("action IN ('insert', 'update')"), "chunk_id", "left_semi")
    made = embed(fresh, "text", "embedding", embedder)
    kept = incoming.join(plan.where("action = 'refresh'"), "chunk_id", "left_semi").join(stored.select("chunk_id", "embedding"), "chunk_id")
    others = stored.join(incoming.select("document_id").distinct(), "document_id", "left_anti")
    columns = [*incoming.columns, "embedding"]
    return made.select(*columns).unionByName(kept.select(*columns)).unionByName(others.select(*columns))


def write_index(index: DataFrame, path: str) -> None:
    """Replaces the rows of the documents in ``index`` and leaves those of all others.

    Documents share ``BUCKETS`` folders by hash, so that files do not become as many as documents. Buckets that a document
    of ``index`` falls into are written anew, with the rows of the other documents in them. A document that lost all its
    chunks has no rows here (see :func:`emptied_documents`).
    """
    bucketed = index.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int"))
    try:
        stored = index.sparkSession.read.parquet(path)
    except AnalysisException:
        stored = None
    if stored is not None:
        touched = bucketed.select("bucket").distinct()
        others = stored.join(F.broadcast(touched), "bucket").join(bucketed.select("document_id").distinct(), "document_id", "left_anti")
        # Written elsewhere first, as the folders that are read are replaced.
        bucketed = materialize(bucketed.unionByName(others.select(*bucketed.columns)))
    bucketed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def emptied_documents(plan: DataFrame) -> DataFrame:
    """Documents of which a plan keeps nothing."""
    return plan.groupBy("document_id").agg(F.max(F.col("action") != "delete").alias("kept")).where("NOT kept").select("document_id")


def index_summary(chunks: DataFrame, model: str, revision: str, config_hash: str, dimension: int) -> DataFrame:
    """(document_id, total, compatible, state): ready if all chunks are of this space, else needs_reindex."""
    mine = (F.col("embedding_model") == model) & (F.col("embedding_revision") == revision) & (F.col("embedding_config_hash") == config_hash) & (F.col("embedding_dimension") == dimension)
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(mine).alias("compatible"))
    return counted.withColumn("state", F.when(F.col("total") == F.col("compatible"), "ready").otherwise("needs_reindex"))


def catalog_listing(catalog: DataFrame, summary: DataFrame) -> DataFrame:
    """Every document with the state of its index; one join instead of two counts per document."""
    joined = catalog.join(summary, "document_id", "left")
    return joined.select(*catalog.columns, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("compatible", F.lit(0)).alias("compatible"), F.coalesce("state", F.lit("not_indexed")).alias("state"))


def ready_questions(questions: DataFrame, catalog: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds ``gate``: not_found, not_ready or open."""
    known = catalog.select("document_id", F.lit(True).alias("known")).distinct()
    ready = summary.where("state = 'ready'").select("document_id", F.lit(True).alias("ready"))
    joined = questions.join(known, "document_id", "left").join(ready, "document_id", "left")
    return joined.select(*questions.columns, F.when(F.col("known").isNull(), "not_found").when(F.col("ready").isNull(), "not_ready").otherwise("open").alias("gate"))


def ingestion_summary(catalog: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame, sections: DataFrame) -> DataFrame:
    """Per document: blocks, tables, cells, top-level sections; 0 where there are none."""
    out = catalog.select("document_id", F.coalesce("page_count", F.lit(0)).alias("pages"))
    parts = (("blocks", blocks), ("tables", tables), ("cells", cells), ("sections", sections.where("parent_section_id IS NULL")))
    for name, df in parts:
        out = out.join(df.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left")
    return out.select("document_id", "pages", *[F.coalesce(name, F.lit(0)).alias(name) for name, _ in parts])
