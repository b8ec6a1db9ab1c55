"""Registered queries of the verification engine: each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import merged_state, state_identity, table_identity
from ..functions.text import numbered
from ..operators import batching, caches, contracts, features, learning, metrics, scoring, shards, splits, trials
from ..scratch import Scratch
from ..sources import canonical, packs, tables, versions, wav
from . import package
from .carriers import embeddings, square, table, utterances
from .file_queries import FILE_QUERIES

WIDTH, SEED, EPOCH = 4, splits.SEED, 0
P, K = 10, 2


def _emb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    scored = scoring.score_trials(trials.neighbour_trials(vectors, WIDTH), vectors.select("path", "embedding"))
    return scored.withColumn("score", F.round("score", 6))


def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emb_scores(spark, sf_dir).select("left_audio_path", "right_audio_path", "target", "score")


def eer_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.equal_error_rate(_emb_scores(spark, sf_dir))
    return found.select("n_genuine", "n_impostor", *[F.round(c, 9).alias(c) for c in ("eer", "eer_threshold", "empirical_threshold", "empirical_far", "empirical_frr")])


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.operating_points(_emb_scores(spark, sf_dir))
    return points.select(F.round("threshold", 9).alias("threshold"), F.round("far", 9).alias("far"), F.round("frr", 9).alias("frr"), "is_anchor")


def empirical_errors_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each percentile of the scores."""
    scores = _emb_scores(spark, sf_dir)
    scores = Scratch(spark, "error-grid").keep(scores, "scores")
    grid = metrics.quantiles(scores, "score", [k / 100 for k in range(0, 101, 5)]).select(F.round("value", 9).alias("threshold")).distinct()
    return metrics.empirical_errors(scores, grid).select("threshold", F.round("far", 9).alias("far"), F.round("frr", 9).alias("frr"))


def score_summary_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.numeric_summary(_emb_scores(spark, sf_dir), "score", "target")
    return summary.select("target", "count", *[F.round(c, 6).alias(c) for c in ("minimum", "mean", "standard_deviation", "q1", "median", "q3", "maximum")])


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    report = package.evaluation_report(trials.neighbour_trials(vectors, WIDTH), vectors.select("path", "embedding"), digits=6)
    means = [F.round(F.col(f"{t}.{c}"), 6).alias(f"{t}_{c}") for t in ("genuine", "impostor") for c in ("mean", "median")]
    return report.select("n_genuine", "n_impostor", *[F.round(c, 9).alias(c) for c in ("eer", "eer_threshold")], *means, "trials_identity")


def generalization_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the rates of the trials of even and of odd vectors."""
    vectors = embeddings(spark, sf_dir)

    def rate(part: int) -> DataFrame:
        own = vectors.where(F.col("vec_id") % 2 == part)
        scored = scoring.score_trials(trials.neighbour_trials(own, WIDTH), own.select("path", "embedding"))
        return metrics.equal_error_rate(scored.withColumn("score", F.round("score", 6)))

    return learning.generalization_gap(rate(1), rate(0)).select(F.round("gap", 9).alias("gap"))


def speaker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(utterances(spark, sf_dir))


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.train_labels(splits.assign_splits(utterances(spark, sf_dir)))


def portable_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.package_tables(utterances(spark, sf_dir))["manifest"]


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_counts(portable_manifest(spark, sf_dir))


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_overlap(portable_manifest(spark, sf_dir))


#: Rows that break one rule each, put beside the carrier's.
BROKEN = [("../1/x.wav", "1"), ("/abs/1/y.wav", "1"), ("1\\z.wav", "1"), ("1:/w.wav", "1"), ("2/v.wav", "3"), ("4/u.mp3", "4"), ("/t.wav", ""), ("5/s.wav", "5"), ("5/S.wav", "5"), ("6/r.wav", "6"), ("6/r.wav", "6")]


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = spark.createDataFrame(BROKEN, "path string, speaker_id string")
    return contracts.utterance_violations(utterances(spark, sf_dir).unionByName(broken))


def manifest_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of a manifest whose rows of paths ending in 7 claim to be validation rows."""
    built = package.package_tables(utterances(spark, sf_dir))
    bent = built["manifest"].withColumn("final_split", F.when(F.col("relative_audio_path").endswith("7.wav"), "validation").otherwise(F.col("final_split")))
    return contracts.manifest_violations(bent, built["speaker_split"], built["speaker_to_label"]).groupBy("rule").agg(F.count("*").alias("n"))


def provenance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.set_difference(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


def case_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.case_collisions(table(spark, sf_dir, "part"), "p_name")


def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_identity(utterances(spark, sf_dir))


def package_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.identities(package.package_tables(utterances(spark, sf_dir)))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.package_tables(utterances(spark, sf_dir))["feature_index"]


def shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


def shard_payload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_totals(_index(spark, sf_dir))


def index_shard_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split the rows, and those that agree with a store whose shard 0 has moved on by one row."""
    index = _index(spark, sf_dir)
    stored = index.withColumn("within_shard_index", F.col("within_shard_index") + F.col("shard_path").endswith("/shard_00000.pt").cast("int"))
    return shards.lookup(index, stored).groupBy("final_split").agg(F.count("*").alias("n_rows"), F.count_if("agrees").alias("n_agree"))


def cache_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, after the rows of paths ending in 77 are lost."""
    index = _index(spark, sf_dir).where(~F.col("relative_audio_path").endswith("77.wav"))
    return contracts.all_of(shards.cache_violations(index), shards.alignment_violations(index)).groupBy("rule").agg(F.count("*").alias("n"))


def _ends(text: str) -> Column:
    return F.col("relative_audio_path").endswith(text)


def _by_rule(found: DataFrame, **more: Column) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n")).select(*[c.alias(k) for k, c in more.items()], "rule", "n")


def index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by version and rule, of the index in its three schemas: offsets of paths ending in 77 have moved on by
    one, bins are 81 where they end in 5, groups unknown where they end in 3, labels out of range where they end in 8."""
    built = package.package_tables(utterances(spark, sf_dir))
    bent = built["feature_index"].withColumns({
        "within_shard_index": F.col("within_shard_index") + _ends("77.wav").cast("int"), "feature_bins": F.when(_ends("5.wav"), 81).otherwise(80), "feature_frames": F.lit(301), "feature_dtype": F.lit("float32"),
        "filename_group": F.when(_ends("3.wav"), "other").otherwise("train"), "manifest_version": F.lit("v2"), "speaker_label": F.when(_ends("8.wav"), 1_000_000).otherwise(F.col("speaker_label")),
    })
    names = {
        1: {"shard_path": "feature_shard_path", "within_shard_index": "feature_index", "feature_bins": "feature_dim"},
        2: {"relative_audio_path": "audio_path", "speaker_label": "label"},
        3: {},
    }
    n = built["speaker_to_label"].count()
    return contracts.all_of(*[_by_rule(caches.index_violations(bent.withColumnsRenamed(r), v, n), version=F.lit(v)) for v, r in names.items()])


def normalised_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows in the first schema, final test rows in the second and validation rows in the third as one table."""
    index = _index(spark, sf_dir).drop("manifest_row_index")
    old = index.where("final_split = 'train'").withColumn("filename_group", F.lit("train"))
    second = index.where("final_split = 'final_test'").withColumns({"filename_group": F.lit("test"), "manifest_version": F.lit("v2")})
    return shards.normalised_index(old, second, index.where("final_split = 'validation'")).select("relative_audio_path", "speaker_label", "filename_group", "duplicate_group", "manifest_version", "manifest_row_index")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 512 vectors as 8 x 8 features, some of which have a number that is not finite or lack their speaker."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit("train").alias("final_split"), numbered("train/shard_", F.expr("vec_id div 512"), tail=".pt").alias("shard_path"), (F.col("vec_id") % 512).cast("int").alias("within_shard_index"),
        F.col("vec_id").cast("string").alias("relative_audio_path"), F.when(F.col("vec_id") % 700 == 3, "").otherwise(F.col("label").cast("string")).alias("speaker_id"), F.col("label").alias("speaker_label"),
        F.when(F.col("vec_id") % 900 == 7, F.array(F.array(F.lit(float("nan")).cast("float")))).otherwise(square(F.col("embedding"))).alias("fbank"),
    )
    return shards.shard_payloads(rows.drop("fbank"), rows.select("relative_audio_path", "fbank"))


def shard_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.payload_violations(_payloads(spark, sf_dir), shape=(8, 8)).select("rule", "key")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against a store that lost a row in 1000, all of validation shard 0, and gained a shard."""
    index = _index(spark, sf_dir).drop("manifest_row_index")
    stored = index.where(~_ends("777.wav") & (F.col("shard_path") != "validation/shard_00000.pt"))
    extra = index.where(F.col("shard_path") == "final_test/shard_00000.pt").withColumn("shard_path", F.lit("final_test/shard_99999.pt"))
    return caches.shard_states(index, stored.unionByName(extra))


def shard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


def plan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.plan_state(_states(spark, sf_dir).where("state != 'unexpected'"))


def concat_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.concat_shards(_index(spark, sf_dir)).select("relative_audio_path", "position")


def cache_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.range(1).select(F.lit(512).alias("shard_size"), F.lit(301).alias("feature_frames"), F.lit(80).alias("feature_bins"))
    return caches.cache_identity(_index(spark, sf_dir), config)


def identity_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of identities of which those of train rows claim one row more."""
    bent = cache_identity(spark, sf_dir).withColumn("n_rows", F.col("n_rows") + (F.col("final_split") == "train").cast("long"))
    return _by_rule(caches.identity_violations(bent, {"kind": "fbank-cache", "n_shards": 1}, "final_split"))


def trial_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir)
    return caches.trial_identity(trials.neighbour_trials(rows, WIDTH), rows)


def score_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of saved scores: some lost, some twice, some of another target, some of no trial."""
    scored = _emb_scores(spark, sf_dir).withColumn("trial_id", F.concat_ws(" ", "target", "left_audio_path", "right_audio_path"))
    left = F.col("left_audio_path")
    kept = scored.where(~left.endswith("77.wav")).withColumns({"target": F.when(left.endswith("5.wav"), 1 - F.col("target")).otherwise(F.col("target")), "trial_id": F.when(left.endswith("31.wav"), F.concat(F.lit("no "), "trial_id")).otherwise(F.col("trial_id"))})
    return _by_rule(caches.score_violations(kept.unionByName(kept.where(left.endswith("9.wav"))), scored))


def input_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of embeddings with relative lengths; every 50th one has lost its vector's end."""
    rows = embeddings(spark, sf_dir).select("path", F.col("label").alias("speaker_label"), (F.col("vec_id") % 101 / 100).alias("relative_length"), F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"))
    return _by_rule(caches.input_violations(rows, 64, 9))


def checkpoint_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of a checkpoint for each user: its place in an epoch of 32 batches follows from its events."""
    user, n = F.col("user_id"), F.col("n")
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = each.select(
        (user % 7).alias("next_epoch"), (n % 40).alias("position"), (user % 7 * 32 + n % 40 + (user % 10 == 0).cast("int")).alias("optimizer_steps"), (user % 7 * 32 + n % 40).alias("scheduler_steps"), F.lit(SEED).alias("sampler_seed"), (user % 8).alias("sampler_epoch"),
        F.lit("abc").alias("configuration_sha256"), (user % 90 == 0).cast("int").alias("final_test_accesses"), F.lit(2).alias("patience"), F.when(user % 60 == 0, 1e-3).otherwise(1e-4).alias("min_improvement"),
    )
    return _by_rule(caches.checkpoint_violations(rows, 32, "abc", SEED))


def duration_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seconds for each utterance, and one tenth more for every speaker's label."""
    rows = portable_manifest(spark, sf_dir).withColumn("duration_sec", F.concat(F.lit("3."), (F.col("speaker_id").cast("long") % 10).cast("string")))
    return splits.duration_totals(rows)


def lineage_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of a manifest without paths ending in 77 whose provenance lacks those ending in 5."""
    rows = utterances(spark, sf_dir)
    manifest, provenance = rows.where(~F.col("path").endswith("77.wav")), rows.where(~F.col("path").endswith("5.wav")).select(F.col("path").alias("relative_path"), "speaker_id")
    return _by_rule(contracts.lineage_violations(manifest, provenance, {"rows": 1, "speakers": 1}, {"finished": True, "validated": False}))


def provenance_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of provenance in which paths ending in 7 are there twice, once in capitals."""
    rows = utterances(spark, sf_dir).select(F.col("path").alias("relative_path"), "speaker_id")
    again = rows.where(F.col("relative_path").endswith("7.wav"))
    return _by_rule(contracts.provenance_violations(rows.unionByName(again.withColumn("relative_path", F.upper("relative_path"))).unionByName(again.where(F.col("relative_path").endswith("77.wav")))))


def train_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of the whole index taken for a training one with 100 labels."""
    return _by_rule(contracts.train_only_violations(_index(spark, sf_dir), 100))


def sampler_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of train rows of which those of paths ending in 77 have the next label."""
    rows = _index(spark, sf_dir).where("final_split = 'train'")
    return contracts.sampler_violations(rows.withColumn("speaker_label", F.col("speaker_label") + _ends("77.wav").cast("int")))


def bound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of documents as files, of which every 10th has other content than was bound, some names are
    not bound, and one source counts as a test set; a null text is a file without content."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.when(F.col("doc_id") % 40 == 3, "test").otherwise("docs"), F.col("doc_id").cast("string"))
    files = docs.select(path.alias("path"), F.col("text").cast("binary").alias("content"))
    bindings = docs.where("doc_id % 25 != 0").select(path.alias("path"), F.sha2(F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"))
    return _by_rule(contracts.bound_file_violations(files, bindings))


def absolute_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.absolute_root_violations(table(spark, sf_dir, "pages"), "html", "example.org").groupBy("rule").agg(F.count("*").alias("n"))


def config_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as configurations that must have size 10 and one brand; the settings that differ are counted together."""
    parts = table(spark, sf_dir, "part").select("p_size", "p_brand")
    return _by_rule(contracts.config_violations(parts, {"p_size": 10, "p_brand": "Brand#4"})).select("rule", "n")


def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed linear map of every embedding, in slices of 32."""
    made = caches.infer(embeddings(spark, sf_dir), lambda x: x[:, :32].astype(float) * 2 - x[:, 32:], "vec_id", "embedding")
    return made.select("vec_id", F.posexplode("embedding").alias("dim", "v")).select("vec_id", "dim", F.round(F.col("v").cast("double"), 5).alias("value"))


def artifact_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of saved embeddings: every 100th is missing, every 70th of another binding."""
    vectors = embeddings(spark, sf_dir)
    saved = vectors.where("vec_id % 100 != 0").select("path", "embedding", F.when(F.col("vec_id") % 70 == 0, "old").otherwise("now").alias("binding"))
    return _by_rule(caches.artifact_violations(saved, vectors.where("vec_id % 90 != 1"), "now", 64))


def full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete batches alone, from the third on."""
    rows = utterances(spark, sf_dir)
    made = batching.random_batches(rows, "path", 32, SEED, EPOCH, drop_last=True)
    return batching.resume(made, 2, max(3, rows.count() // 32))


def legacy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of legacy trials after every 1000th one is lost."""
    made = trials.legacy_trials(utterances(spark, sf_dir), cap=100)
    return trials.contiguous_violations(made.where("trial_id % 1000 != 999"))


def saved_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as CSV and read back by their strict schema."""
    scored = trial_scores(spark, sf_dir).select(F.concat_ws(" ", "left_audio_path", "right_audio_path").alias("trial_id"), "target", "score")
    path = Scratch(spark, "saved-scores").path("scores")
    tables.write_csv(scored, path, F.col("trial_id"), F.col("target"))
    return tables.read_csv(spark, path, tables.SCORES)


def saved_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, bytes and order-dependent digest of the manifest's CSV files, and in how many ways they differ from its
    rendering and from that of a manifest in the other order."""
    rows, path = portable_manifest(spark, sf_dir), Scratch(spark, "saved-csv").path("manifest")
    rows = Scratch(spark, "saved-csv").keep(rows, "rows")
    order = F.col("relative_audio_path")
    tables.write_csv(rows, path, order)
    stored = Scratch(spark, "saved-csv").keep(canonical.stored_lines(spark, path), "stored")
    differ = lambda name, o: canonical.csv_violations(rows, path, o, stored=stored).agg(F.count("*").alias(name))
    found = canonical.stored_identity(stored)
    return found.join(F.broadcast(differ("n_differences", order))).join(F.broadcast(differ("n_reversed", order.desc())))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files: the state of all, that of two halves merged, and that after every 7th one is removed."""
    files = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_id").alias("path"), F.col("event_id").alias("size"), F.col("user_id").alias("modified"), F.col("event_id").alias("n"))
    half = lambda k: wav.snapshot(files.where(F.col("n") % 2 == k))
    parts = {"whole": wav.snapshot(files), "merged": merged_state(half(0), half(1)), "removed": wav.updated_snapshot(wav.snapshot(files), removed=files.where("n % 7 = 0"))}
    return contracts.all_of(*[state_identity(s).select(F.lit(name).alias("state"), "n_rows", "identity") for name, s in parts.items()])


def saved_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as canonical JSON lines, read back as text."""
    path = Scratch(spark, "saved-json").path("lines")
    tables.write_json_lines(portable_manifest(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def published_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the package's tables after publishing it twice: created, then found equal."""
    built, root = package.package_tables(utterances(spark, sf_dir)), Scratch(spark, "published").path("package")
    states = [versions.publish(built, root) for _ in range(2)]
    counts = [rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", *[F.lit(x).alias(c) for x, c in zip(states, ("first", "second"))]) for name, rows in versions.open_tables(spark, root, check=True).items()]
    return contracts.all_of(*counts)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The index without its row numbers, and a store of it that was written in two runs, 40 shards a file."""
    index, root = _index(spark, sf_dir).drop("manifest_row_index"), Scratch(spark, "packed-shards").path("shards")
    packs.write(index.where("final_split != 'train'"), root, shards_per_pack=40)
    packs.write(index, root, shards_per_pack=40)
    return index, root


def stored_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two shards of each split of a packed store, at their places in the whole store."""
    index, root = _packed(spark, sf_dir)
    names = [r[0] for r in index.where(F.col("shard_path").rlike("_0000[01][.]")).select("shard_path").distinct().collect()]
    near = packs.read(spark, root, names).select("relative_audio_path")
    return caches.concat_shards(packs.read(spark, root)).join(near, "relative_audio_path").select("relative_audio_path", "shard_path", "within_shard_index", "position")


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and first row in its file of each shard of a packed store."""
    return packs.index(spark, _packed(spark, sf_dir)[1]).select("shard", "pack", "first_row", "n_rows")


def stored_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards, rows and files of a packed store."""
    return packs.totals(spark, _packed(spark, sf_dir)[1]).select("n_shards", "n_rows", "n_files")


def _total(rows: DataFrame) -> int:
    """Five trials a speaker, and one more for half of them."""
    n = rows.select("speaker_id").distinct().count()
    return 5 * n + n // 2


def genuine_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir)
    return trials.balanced_quotas(rows, _total(rows), trials.GENUINE_QUOTA)


def genuine_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir)
    return trials.genuine_trials(rows, _total(rows)).select(*trials.COLUMNS)


def impostor_speaker_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir)
    return trials.impostor_speaker_pairs(rows, _total(rows)).select("position", "speaker_a", "speaker_b")


def impostor_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir)
    return trials.impostor_trials(rows, _total(rows))


def balanced_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir)
    return trials.with_trial_ids(trials.genuine_trials(rows, _total(rows)), trials.impostor_trials(rows, _total(rows)), "trial-")


def paired_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.paired_rounds(utterances(spark, sf_dir), 6)


def legacy_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.legacy_trials(utterances(spark, sf_dir), cap=100)


def neighbour_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.neighbour_trials(utterances(spark, sf_dir), WIDTH)


def trial_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.participation(trials.neighbour_trials(utterances(spark, sf_dir), WIDTH))


def trial_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, by rule, of trials of which those with a left path ending in 7 claim the other target."""
    rows = utterances(spark, sf_dir)
    made = trials.neighbour_trials(rows, WIDTH).withColumn("trial_id", F.concat_ws(" ", "target", "left_audio_path", "right_audio_path"))
    bent = made.withColumn("target", F.when(F.col("left_audio_path").endswith("7.wav"), 1 - F.col("target")).otherwise(F.col("target")))
    return trials.trial_violations(bent, rows).groupBy("rule").agg(F.count("*").alias("n"))


def random_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.random_batches(utterances(spark, sf_dir), "path", 32, SEED, EPOCH)


def _pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.pk_batches(utterances(spark, sf_dir), P, K, SEED, EPOCH)


def pk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pk(spark, sf_dir)


def hybrid_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two shards."""
    index = _index(spark, sf_dir).where("final_split = 'train'").select("shard_path", "speaker_id", F.col("relative_audio_path").alias("path"))
    return batching.windowed_batches(index, P, K, 2, SEED, EPOCH)


def batch_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.speaker_exposure(hybrid_batches(spark, sf_dir))


def batch_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.shards_per_batch(hybrid_batches(spark, sf_dir))


def epoch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.epoch_stats(_pk(spark, sf_dir))


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.round_robin(_pk(spark, sf_dir)).select("batch_id", "slot", "speaker_id", "path", "position")


def microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.microbatches(_pk(spark, sf_dir), P)


def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir)
    return batching.collate(_pk(spark, sf_dir), rows, "speaker_id").select("batch_id", F.concat_ws(" ", "paths").alias("paths"), F.concat_ws(" ", "speaker_id").alias("speakers"))


def _centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = embeddings(spark, sf_dir)
    return vectors, learning.class_centroids(vectors)


def class_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids(spark, sf_dir)[1].select("class", F.posexplode("weights").alias("dim", "w")).select("class", "dim", F.round("w", 6).alias("weight"))


def _logits(spark: SparkSession, sf_dir: str, margin: bool) -> DataFrame:
    rows = learning.cosines_to_classes(*_centroids(spark, sf_dir), "vec_id")
    logit = learning.margin_logit(F.col("cos"), F.col("label") == F.col("class")) if margin else learning.softmax_logit(F.col("cos"))
    return rows.withColumn("logit", logit)


def softmax_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir, False).select("vec_id", "class", F.round("logit", 5).alias("logit"))


def aam_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir, True).select("vec_id", "class", F.round("logit", 5).alias("logit"))


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By blocks of four classes."""
    return learning.cross_entropy(*_centroids(spark, sf_dir), "vec_id", learning.margin_logit, limit=4 * 64).select("vec_id", F.round("loss", 5).alias("loss"))


def cosine_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step for each batch of an epoch."""
    steps = batching.random_batches(utterances(spark, sf_dir), "path", 32, SEED, EPOCH).select(F.col("batch_id").alias("step")).distinct()
    horizon = steps.agg(F.max("step")).first()[0] or 0
    return learning.cosine_learning_rate(steps, horizon).select("step", F.round("factor", 9).alias("factor"), F.round("learning_rate", 12).alias("learning_rate"))


def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are epochs, the mean event value of a type is its history."""
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.round(F.avg("value"), 6).alias("value"))
    epochs = daily.select("event_type", F.datediff("d", F.lit("2024-01-01").cast("date")).alias("epoch"), "value")
    return learning.early_stopping(epochs, 1e-4, 2, "event_type")


def mean_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.mean_norm(embeddings(spark, sf_dir).select("vec_id", "label", "embedding"), "embedding", "label")
    return rows.select("vec_id", F.posexplode("normalized").alias("dim", "v")).select("vec_id", "dim", F.round("v", 6).alias("value"))


def mean_var_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.mean_var_norm(embeddings(spark, sf_dir).select("vec_id", "label", "embedding"), "embedding", "label")
    return rows.select("vec_id", F.posexplode("normalized").alias("dim", "v")).select("vec_id", "dim", F.round("v", 5).alias("value"))


def framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = features.frame_means(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 5, 2)
    return framed.select("user_id", "frame", "n", F.round("mean", 6).alias("mean"))


def max_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the embeddings and their values rounded to four places."""
    rows = embeddings(spark, sf_dir).select("vec_id", "embedding")
    near = rows.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)))
    return metrics.max_difference(near, rows, "vec_id", "embedding").select("n", F.round("max_abs_diff", 6).alias("max_abs_diff"), "all_close")


def norm_and_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("vec_id", "embedding")
    half = rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / 2))
    found = metrics.norm_and_delta(rows, half, "vec_id", "embedding")
    return found.select(*[F.round(c, 4).alias(c) for c in ("norm", "max_delta", "sum_delta")], "n_bad")


QUERIES = {
    f.__name__: f
    for f in (
        eer_trials, operating_points, empirical_errors_grid, score_summary_by_target, trial_scores, evaluation_report, generalization_gap,
        speaker_split, train_labels, portable_manifest, split_counts, split_overlap, contract_violations, manifest_invariants, provenance_diff, case_collisions, canonical_identity, package_identities,
        shard_index, shard_payload_sizes, index_shard_alignment, cache_completeness,
        index_rules, normalised_index, shard_contract, shard_states, plan_state, concat_shards, cache_identity, identity_contract, trial_identity, score_alignment, input_guards, checkpoint_contract, duration_totals,
        saved_scores, saved_csv, saved_json, snapshots, published_package, stored_shards, stored_index, stored_totals,
        lineage_contract, provenance_contract, train_guard, sampler_contract, bound_files, absolute_roots, config_contract, inference, artifact_reuse, full_batches, legacy_ids,
        genuine_quota, genuine_trials, impostor_speaker_pairs, impostor_trials, balanced_trials, paired_rounds, legacy_trials, neighbour_trials, trial_participation, trial_validity,
        random_batches, pk_batches, hybrid_batches, batch_exposure, batch_shards, epoch_stats, round_robin, microbatches, collated_batches,
        class_centroids, softmax_logits, aam_logits, cross_entropy, cosine_lr, early_stopping, mean_norm, mean_var_norm, framing, max_difference, norm_and_delta,
    )
}
QUERIES |= FILE_QUERIES
