"""Token counts by source, language and tokenizer version, maintained from deltas.

Inserts, deletes and revised counts become signed rows, which are summed before they are written: a batch is a small table
of changes of the totals. Totals are additive, so they are the sum of the batches. A batch is staged under a name of its own
and committed by creating one marker file that must not exist yet and that names the staged table. A batch that is
applied again, after a lost executor or driver or by mistake, finds its marker and changes nothing; a staged table that
no marker names is never read. ``compact`` sums the committed batches into one table, committed in the same way.

Nulls: null sources, languages and versions are groups of their own; a null count is 0. Groups that come back to no
documents and no tokens vanish from the totals. An empty batch may be committed. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.sources.scratch import scratch

from . import packing, sentencepiece_fst
from .common import settled, table
from .idcache import slices

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs bigint, n_tokens bigint"


def signed(changes: DataFrame) -> DataFrame:
    """Deltas of changes: op (insert, delete or revise), the keys and tokens; a revised row has its old ones in ``old_*``."""
    side = lambda prefix, sign: F.struct(*[F.col(f"{prefix}{k}").cast("string").alias(k) for k in KEYS], F.lit(sign).alias("d"), (sign * F.coalesce(F.col(f"{prefix}tokens"), F.lit(0))).cast("long").alias("t"))
    rows = F.when(F.col("op") == "insert", F.array(side("", 1))).when(F.col("op") == "delete", F.array(side("", -1)))
    rows = rows.when(F.col("op") == "revise", F.array(side("old_", -1), side("", 1))).otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce("op", F.lit("null")))))
    return _summed(changes.select(F.explode(rows).alias("x")).select(*[f"x.{k}" for k in KEYS], F.col("x.d").cast("long").alias("n_docs"), F.col("x.t").alias("n_tokens")))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """A store in one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, name: str, content: dict) -> bool:
        """Creates a marker; False if another writer has."""
        path = self._path(f"{self.root}/commits/{name}")
        if self._fs.exists(path):
            return False
        own = self._path(f"{self.root}/staged/marker-{uuid.uuid4().hex}")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.mkdirs(path.getParent())
        try:
            # A rename never leaves half a marker, and fails where the name is taken.
            done = bool(self._fs.rename(own, path))
        except Exception:
            if not self._fs.exists(path):
                raise
            done = False
        return done

    def _names(self) -> list[str]:
        """Names of all markers, in order."""
        folder = self._path(f"{self.root}/commits")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(n for n in (x.getPath().getName() for x in found) if not n.endswith(".crc"))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commits/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/commits/batch-{batch}"))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch of changes; False, and no change, if the batch was committed before."""
        if self.committed(batch):
            return False
        return self._write(f"batch-{batch}", signed(changes), {})

    def _write(self, name: str, rows: DataFrame, more: dict) -> bool:
        staged = f"{self.root}/staged/{name}-{uuid.uuid4().hex}"
        rows.hint("rebalance").write.parquet(staged)
        return self._marker(name, {"table": staged} | more)

    def _state(self) -> tuple[list[str], list[str]]:
        """Names of all committed batches, and the tables whose sum is the state. Only the last compaction's marker and those
        of the batches after it are read."""
        names = self._names()
        compact = [n for n in names if n.startswith("compact-")]
        whole = self._read(compact[-1]) if compact else {"batches": [], "table": None}
        batches = [n for n in names if n.startswith("batch-")]
        tables = [whole["table"]] if whole["table"] else []
        return batches, tables + [self._read(n)["table"] for n in batches if n not in set(whole["batches"])]

    def totals(self) -> DataFrame:
        _, tables = self._state()
        if not tables:
            return self.spark.createDataFrame([], SCHEMA)
        return _summed(self.spark.read.schema(SCHEMA).parquet(*tables)).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Sums the batches committed so far into one table; False if another writer did at the same time."""
        batches, tables = self._state()
        if not tables:
            return False
        number = sum(n.startswith("compact-") for n in self._names())
        return self._write(f"compact-{number:08d}", _summed(self.spark.read.schema(SCHEMA).parquet(*tables)), {"batches": batches})


def tokenized(docs: DataFrame) -> DataFrame:
    """source, lang, ``w`` (whitespace words) and the tokens of every row by the word tokenizer (``bpe``) and the piece model (``piece``)."""
    word_path = packing.tokenizer_path()
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_fst._model(sentencepiece_fst.model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fst = packing._encoder(word_path), sentencepiece_fst._compiled(model.value)
        for b in batches:
            for at, past in slices(b.column(2)):
                part = b.slice(at, past - at)
                counts = *encoder.counts(part.column(2)), fst.counts(part.column(2))
                yield pa.record_batch([*part.columns[:2], *(pa.array(n, pa.int64()) for n in counts)], ["source", "lang", "w", "bpe", "piece"])

    rows = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return rows.mapInArrow(run, "source string, lang string, w bigint, bpe bigint, piece bigint")


#: Versions of the totals of ``corpus_counts``, and the columns of ``tokenized`` that have their counts.
TOKENIZERS = {"word_bpe_49k": "bpe", "piece_bpe_32k": "piece"}


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all of ``documents`` by both real tokenizers after four batches: all inserted by the word tokenizer and, as
    a first guess to be revised, by whitespace words; those of under ten words deleted, sent twice; these inserted again by
    both; the guesses of the others revised to the counts of the piece model. The store is compacted between."""
    counted = settled(tokenized(table(spark, sf_dir, "documents")), "tokenized")
    rollup = Rollup(spark, scratch(spark, "token-rollup"))
    bpe, piece = TOKENIZERS
    none = [F.lit(None).cast("string").alias(f"old_{k}") for k in KEYS] + [F.lit(None).cast("long").alias("old_tokens")]

    def rows(op: str, of: DataFrame, counts: dict[str, str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("tokens")) for v, c in counts.items()]))
        return of.select("source", "lang", each.alias("x")).select(F.lit(op).alias("op"), "source", "lang", "x.version", "x.tokens", *none)

    short, rest = counted.where("w < 10"), counted.where("w >= 10")
    guess = {bpe: TOKENIZERS[bpe], "words-1": "w"}
    rollup.apply("0001", rows("insert", counted, guess))
    for _ in range(2):
        rollup.apply("0002", rows("delete", short, guess))
    rollup.compact()
    rollup.apply("0003", rows("insert", short, TOKENIZERS))
    old = [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit("words-1").alias("old_version"), F.col("w").alias("old_tokens")]
    rollup.apply("0004", rest.select(F.lit("revise").alias("op"), "source", "lang", F.lit(piece).alias("version"), F.col(TOKENIZERS[piece]).alias("tokens"), *old))
    return rollup.totals()
