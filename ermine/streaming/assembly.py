"""Classification and assembly on Structured Streaming.

X2: every micro-batch of fragments is consolidated by itself, one row a key (a class, an attribute, a relation),
and written as the batch's own folder of a state table in shared storage.  What the rows keep - the first spelling, type
and multiplicity with the order they stood at - merges in any order, so reading the state is one more aggregate over
the batches, then the joins of A6 and A7.  A batch that is run again overwrites its own folder: nothing counts
twice.  Nothing passes through the driver.

X1: every micro-batch of texts is scored against stored parameter tables of C4, which do not change during
the stream, and written as its own folder likewise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble as M
from ..operators import classify as C

CLASS_SCHEMA = "model string, seq long, class_pos int, class_name string, kind string"
ATTR_SCHEMA = "model string, seq long, class_name string, attr_pos int, attr_name string, attr_type string"
REL_SCHEMA = "model string, seq long, src string, dst string, mult string, rel_name string"

# table -> (schema of its fragments, consolidation of a batch, merge of batches)
TABLES = {
    "classes": (CLASS_SCHEMA, M.canonical_classes, M.merge_classes),
    "attributes": (ATTR_SCHEMA, M.partial_attributes, M.merge_attributes),
    "rels": (REL_SCHEMA, M.merged_relations, M.merge_relations),
}


def write_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """The rows of one batch, as its own folder; run again, they replace it."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def _drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_assembly(spark: SparkSession, fragments_dir: str, state_dir: str, checkpoint: str,
                    schemas: dict[str, str] | None = None, max_files: int = 100) -> None:
    """Takes what is new in ``fragments_dir/{classes,attributes,rels}`` into the state tables.

    ``schemas`` replaces the schema of a table, for a ``seq`` or ``model`` of another type.
    """
    for name, (schema, consolidate, _) in TABLES.items():
        s = (spark.readStream.schema((schemas or {}).get(name, schema)).option("maxFilesPerTrigger", max_files)
             .parquet(f"{fragments_dir}/{name}"))

        def each(batch: DataFrame, number: int, name=name, consolidate=consolidate) -> None:
            write_batch(consolidate(batch), f"{state_dir}/{name}", number)

        _drain(s, each, f"{checkpoint}/{name}")


def _state(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    return TABLES[name][2](spark.read.option("basePath", f"{state_dir}/{name}").parquet(f"{state_dir}/{name}/batch=*"))


def read_assembly(spark: SparkSession, state_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model tables (A1) of all fragments taken in so far."""
    canon, attrs, rels = (_state(spark, state_dir, name) for name in TABLES)
    return M.consolidate(canon, M.owned(attrs, canon), rels)


def compact(spark: SparkSession, state_dir: str, new_dir: str) -> None:
    """The state merged into one batch of another folder, for streams that go on there with the same checkpoint.

    It stands as batch -1, so no batch of the stream replaces it."""
    for name in TABLES:
        write_batch(_state(spark, state_dir, name), f"{new_dir}/{name}", -1)


def stream_classify(spark: SparkSession, text_dir: str, model_dir: str, sink_dir: str, checkpoint: str,
                    schema: str = "doc_id long, text string", max_files: int = 100) -> None:
    """The kind of every new text, by the saved Bernoulli model; ``sink_dir`` gets (doc_id, prediction, score)."""
    base, params = C.load_bernoulli(spark, model_dir)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(text_dir)

    def each(batch: DataFrame, number: int) -> None:
        scores = C.bernoulli_score(base, params, C.term_counts(batch), batch.select("doc_id"))
        write_batch(C.predict(scores), sink_dir, number)

    _drain(s, each, checkpoint)


def read_predictions(spark: SparkSession, sink_dir: str) -> DataFrame:
    """What the stream has predicted so far."""
    return spark.read.parquet(f"{sink_dir}/batch=*").select("doc_id", "prediction", F.col("score"))
