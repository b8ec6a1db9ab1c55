"""Registered queries that write files made from the tables and read them back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import canonical_pair
from ..functions.text import shortest_float
from ..operators import batching, caches, contracts, features, splits, trials
from ..scratch import Scratch
from ..sources import tables, versions, wav
from . import package
from .carriers import embeddings, square, table, utterances

#: Samples of a file, and their rate.
SAMPLES, RATE = 48_000, 16_000


def _tree(spark: SparkSession, sf_dir: str, where: str = "true", name: str = "0.wav", samples: int = SAMPLES, slow: str = "false", root: str | None = None) -> str:
    """Root of a tree with a WAV file for each user, whose samples are the values of its events round and round."""
    root = root or Scratch(spark, "wav-tree").path("wavs")
    sample = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor("value"))).cast("int")
    users = table(spark, sf_dir, "events").where(where).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", sample.alias("x")))), lambda s: s["x"]).alias("v"))
    turned = F.slice(F.flatten(F.array_repeat("v", F.ceil(samples / F.size("v")).cast("int"))), 1, samples)
    wav.write(users.select(F.concat(F.col("user_id").cast("string"), F.lit(f"/{name}")).alias("path"), F.when(F.expr(slow), RATE // 2).otherwise(RATE).alias("rate"), turned.alias("samples")), root)
    return root


def wav_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wav.headers(wav.discover(spark, _tree(spark, sf_dir))).drop("compression")


def audio_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a tree in which the files of some users have half the rate."""
    return contracts.audio_violations(wav.headers(wav.discover(spark, _tree(spark, sf_dir, slow="user_id % 10 = 3"))))


def wav_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sum of each file's samples."""
    found = wav.keep(wav.discover(spark, _tree(spark, sf_dir)).select("path", wav.sample_totals(wav.samples("content")).alias("t")), "totals")
    return found.select("path", "t.n", "t.total")


def wav_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and bins of each file's features, and whether all of them are finite and of one size."""
    found = wav.keep(wav.discover(spark, _tree(spark, sf_dir)).select("path", features.shape_udf(features.fbank_udf(wav.samples("content"))).alias("f")), "shapes")
    return found.select("path", "f.frames", "f.bins", "f.whole")


def wav_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in a tree after some files were written anew, at half their length, and others were added."""
    root = _tree(spark, sf_dir)
    listing = lambda: wav.discover(spark, root).select("path", "size", "modified")
    before = wav.keep(listing(), "before")
    _tree(spark, sf_dir, "user_id % 10 = 4", samples=SAMPLES // 2, root=root)
    _tree(spark, sf_dir, "user_id % 10 = 5", name="1.wav", root=root)
    return wav.changed(before, wav.keep(listing(), "after"))


def dataset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.dataset_identity(wav.discover(spark, _tree(spark, sf_dir)))


def created_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split of a package that was created from WAV files, and then found as it should be."""
    root, out = _tree(spark, sf_dir), Scratch(spark, "created").path("package")
    first, second = (package.create_package(spark, root, out) for _ in range(2))
    manifest = versions.open_tables(spark, out, check=True)["manifest"]
    return manifest.groupBy("final_split").agg(F.count("*").alias("n_rows")).select(F.lit(first).alias("first"), F.lit(second).alias("second"), "final_split", "n_rows")


def built_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of a feature cache that was built of the manifest, with an event's value as its features."""
    out = Scratch(spark, "built-cache").path("cache")
    config = spark.range(1).select(F.lit(512).alias("shard_size"), F.lit(301).alias("feature_frames"), F.lit(80).alias("feature_bins"))
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    values = table(spark, sf_dir, "events").select(F.concat(user, F.lit("/"), event, F.lit(".wav")).alias("relative_audio_path"), F.array(F.array("value")).alias("fbank"))
    package.build_cache(package.package_tables(utterances(spark, sf_dir))["manifest"], values, config, out, shape=(1, 1))
    return spark.read.parquet(f"{out}/identity")


def read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, written as CSV and read back by its strict schema."""
    path = Scratch(spark, "read-manifest").path("manifest")
    tables.write_csv(package.package_tables(utterances(spark, sf_dir))["manifest"], path, F.col("relative_audio_path"))
    return tables.read_csv(spark, path, tables.PORTABLE)


def _tried(spark: SparkSession, states: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"{k + 1} {s}",) for k, s in enumerate(states)], "state string")


def exact_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three writes of the utterances to one place say, the last one with a row changed; and the rows stored."""
    rows, path, states = utterances(spark, sf_dir), Scratch(spark, "exact-write").path("utterances"), []
    first = rows.agg(F.min("path")).first()[0]
    for own in (rows, rows, rows.withColumn("path", F.when(F.col("path") == first, "x").otherwise(F.col("path")))):
        try:
            states.append(tables.write_exact(own, path))
        except ValueError:
            states.append("refused")
    return _tried(spark, states).join(F.broadcast(spark.read.parquet(path).agg(F.count("*").alias("n_rows"))))


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object for each type of event, written to a file of its own and read back by its strict schema."""
    path = Scratch(spark, "config-files").path("objects")
    each = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    each.write.partitionBy("event_type").json(path)
    return tables.read_json(spark, path, "n long, last long, event_type string").select("event_type", "n", "last")


def first_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the first four embeddings as 8 x 8 features, of which one is not a number and one has lost a row."""
    bent = F.when(F.col("vec_id") == 1, F.array(F.array(F.lit(float("nan")).cast("float")))).when(F.col("vec_id") == 2, F.slice(square(F.col("embedding")), 1, 7)).otherwise(square(F.col("embedding")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("relative_audio_path"), F.lit("train").alias("final_split"), F.col("vec_id").alias("manifest_row_index"), bent.alias("fbank"))
    return caches.first_batch_violations(rows, "train", shape=(8, 8)).select("rule", "key")


def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials whose sides were changed over where the left path ends in an odd digit, with their sides in order again."""
    made = trials.neighbour_trials(utterances(spark, sf_dir), 4)
    left, right, odd = F.col("left_audio_path"), F.col("right_audio_path"), F.col("left_audio_path").rlike("[13579][.]wav$")
    low, high = canonical_pair(F.when(odd, right).otherwise(left), F.when(odd, left).otherwise(right))
    return made.select(low.alias("low"), high.alias("high")).groupBy("low", "high").agg(F.count("*").alias("n"))


def shortest_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of event values as they are, 1e14 times as large and 1e-7 times as large."""
    scaled = F.array(*[F.struct(F.lit(p).alias("power"), (F.col("value") * 10.0**p).alias("x")) for p in (0, 14, -7)])
    return table(spark, sf_dir, "events").select("event_id", F.explode(scaled).alias("s")).select("event_id", "s.power", shortest_float(F.col("s.x")).alias("text"))


def checkpoint_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two checkpoints saved at one place, as it is loaded; its position follows from the events."""
    path, n = Scratch(spark, "checkpoints").path("last"), table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    for epoch in (1, 2):
        position = F.col("n") % 32
        row = n.select(
            F.lit(epoch).alias("next_epoch"), position.alias("position"), (epoch * 32 + position).alias("optimizer_steps"), (epoch * 32 + position).alias("scheduler_steps"), F.lit(splits.SEED).alias("sampler_seed"), F.lit(epoch).alias("sampler_epoch"),
            F.lit("abc").alias("configuration_sha256"), F.lit(0).alias("final_test_accesses"), F.lit(caches.PATIENCE).alias("patience"), F.lit(caches.MIN_IMPROVEMENT).alias("min_improvement"),
        )
        package.save_checkpoint(row, path, 32, "abc", splits.SEED)
    loaded = package.load_checkpoint(spark, path, 32, "abc", splits.SEED)
    return loaded.select("next_epoch", "position", "optimizer_steps", F.lit(len(versions.history(spark, path)) - 1).alias("versions_before"))


def final_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials of the final report, and what a second one says."""
    vectors, out = embeddings(spark, sf_dir), Scratch(spark, "final").path("report")
    made, again = trials.neighbour_trials(vectors, 4), "made"
    report = package.final_evaluation(made, vectors.select("path", "embedding"), out)
    try:
        package.final_evaluation(made, vectors.select("path", "embedding"), out)
    except ValueError:
        again = "refused"
    return report.select("n_genuine", "n_impostor", F.lit(again).alias("again"))


def fed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a consumer sees that is fed with all batches of an epoch: rows, first path, and whether numbers ascend."""
    rows = utterances(spark, sf_dir)
    collated = batching.collate(batching.pk_batches(rows, 10, 2, splits.SEED, 0), rows, "speaker_id")

    def consume(fed: Iterator[dict]) -> Iterator[dict]:
        last = -1
        for batch in fed:
            yield {"batch_id": batch["batch_id"], "n_rows": len(batch["paths"]), "first": min(batch["paths"]), "ascending": batch["batch_id"] > last}
            last = batch["batch_id"]

    return batching.feed(collated, consume, "batch_id long, n_rows long, first string, ascending boolean", 8)


FILE_QUERIES = {
    f.__name__: f
    for f in (
        wav_headers, audio_contract, wav_samples, wav_features, wav_changes, dataset_identity, created_package, built_cache, read_manifest, exact_write, config_files, first_batch, canonical_pairs, shortest_floats,
        checkpoint_store, final_once, fed_batches,
    )
}
