"""Balanced verification trials: quotas, genuine and impostor pairs, participation, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import stable_digest
from ..functions.permutation import div, gcd, keyed_permutation, pair_of
from ..functions.ranking import digest_rank, ordered_rank, running_total
from ..functions.text import numbered
from ..scratch import Scratch
from .contracts import all_of, duplicates, row_violations, violations
from .splits import SEED

#: Purposes in the digests.
GENUINE_QUOTA, IMPOSTOR_QUOTA, IMPOSTOR_SPEAKER, GENUINE, IMPOSTOR = "genuine-quota", "negative-participation", "negative-speaker", "genuine", "impostor"
#: Utterances of a speaker that are paired at once with another such block.
BLOCK = 512

COLUMNS = ("left_audio_path", "right_audio_path", "left_speaker_id", "right_speaker_id", "target")


def balanced_quotas(utterances: DataFrame, total: int, purpose: str, seed: int = SEED) -> DataFrame:
    """Rows (speaker_id, quota) that add up to ``total``; speakers first by digest get one more than the others."""
    speakers = utterances.select("speaker_id").distinct().withColumn("_d", stable_digest(seed, purpose, F.col("speaker_id")))
    n = speakers.count()
    if not n:
        raise ValueError("there are no speakers")
    return digest_rank(speakers, "_d", "speaker_id").select("speaker_id", (F.lit(total // n) + (F.col("rank") < total % n).cast("long")).alias("quota"))


#: Hex digits of a pair's digest that are held against its speaker's bound.
BOUND_DIGITS = 12


def _least_pairs(utterances: DataFrame, quotas: DataFrame, seed: int, slack: float = 6.0) -> DataFrame:
    """Of all pairs of each speaker those of least digest, as many as its quota (fewer if it has fewer); rows (speaker_id,
    a, b, digest, quota).

    Digests are uniform, so of a speaker's pairs about as many lie below a bound as its share of the range says.  The bound
    is set to let ``slack`` standard deviations more than the quota through; all pairs are formed, hashed and held against
    it where they are met, and only those below it are shuffled and sorted.  Speakers of whom too few came through (one in
    millions) go again without a bound, so the result is exact.
    """
    scratch = Scratch(utterances.sparkSession, "least-pairs")
    paths = utterances.select("speaker_id", "path").distinct()
    n, wanted = F.col("n").cast("double"), F.col("quota") + slack * (F.sqrt("quota") + 1)
    share = wanted / F.greatest(n * (n - 1) / 2, F.lit(1.0))
    bound = F.when(share < 1, F.lower(F.lpad(F.hex(F.floor(share * 16.0**BOUND_DIGITS)), BOUND_DIGITS, "0")))
    sizes = paths.groupBy("speaker_id").agg(F.count("*").alias("n")).join(quotas.where("quota > 0"), "speaker_id")
    sizes = scratch.keep(sizes.select("speaker_id", "quota", F.least(F.col("quota"), F.expr("n * (n - 1) div 2")).alias("most"), F.ceil(n / BLOCK).cast("int").alias("blocks"), bound.alias("bound")), "sizes")

    def least(speakers: DataFrame, name: str) -> DataFrame:
        placed = paths.join(speakers, "speaker_id").withColumn("block", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
        dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("speaker_id", "quota", "bound", "path", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        other = dealt.select(*[F.col(c).alias(f"_{c}") for c in ("speaker_id", "path", "block", "low", "high")])
        same_blocks = (F.col("speaker_id") == F.col("_speaker_id")) & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
        pairs = dealt.join(other, same_blocks & (F.col("path") < F.col("_path")) & ((F.col("low") == F.col("high")) | (F.col("block") != F.col("_block"))))
        digest = stable_digest(seed, GENUINE, F.col("speaker_id"), F.col("path"), F.col("_path"))
        below = pairs.withColumn("digest", digest).where(F.col("bound").isNull() | (F.col("digest") < F.col("bound"))).select("speaker_id", F.col("path").alias("a"), F.col("_path").alias("b"), "digest", "quota")
        place = F.row_number().over(Window.partitionBy("speaker_id").orderBy("digest", "a", "b"))
        return scratch.keep(below.withColumn("place", place).where("place <= quota").drop("place"), name)

    found = least(sizes, "below")
    short = sizes.join(found.groupBy("speaker_id").agg(F.count("*").alias("found")), "speaker_id", "left").where("coalesce(found, 0) < most").select(*sizes.columns)
    if not short.take(1):
        return found
    short = scratch.keep(short.withColumn("bound", F.lit(None).cast("string")), "short")
    return found.join(short, "speaker_id", "left_anti").unionByName(least(short, "again"))


def genuine_trials(utterances: DataFrame, total: int, seed: int = SEED) -> DataFrame:
    """Per speaker the pairs of least digest, as many as its quota; columns ``COLUMNS`` and ``digest``.

    All pairs of a speaker compete by definition.  Its utterances are dealt into blocks and pairs are formed and hashed
    block against block, so a speaker with many utterances spreads over the cluster, and little more of its pairs than its
    quota is shuffled.  A speaker that cannot fill its quota is an error.
    """
    scratch = Scratch(utterances.sparkSession, "genuine-trials")
    quotas = scratch.keep(balanced_quotas(utterances, total, GENUINE_QUOTA, seed), "quotas")
    chosen = _least_pairs(utterances, quotas, seed)
    supply = quotas.where("quota > 0").join(chosen.groupBy("speaker_id").agg(F.count("*").alias("n")), "speaker_id", "left")
    if supply.where("coalesce(n, 0) < quota").take(1):
        raise ValueError("a speaker cannot supply its genuine quota")
    return chosen.select(F.col("a").alias("left_audio_path"), F.col("b").alias("right_audio_path"), F.col("speaker_id").alias("left_speaker_id"), F.col("speaker_id").alias("right_speaker_id"), F.lit(1).alias("target"), "digest")


def impostor_speaker_pairs(utterances: DataFrame, total: int, seed: int = SEED) -> DataFrame:
    """Rows (position, speaker_a, speaker_b): ``total`` pairs of speakers with balanced participation.

    Speakers take part in rounds.  Those with the greater quota go first, then all of them as often as the lesser quota
    says, each round in the order of a digest of its own, so at every position the two taken have most of their quota
    left.  Endpoints 2p and 2p + 1 of all rounds laid end to end meet at position p; where a round of odd size would pair
    a speaker with itself across the border, the first two of the next round change places.  Fewer than two speakers are
    an error.
    """
    quotas = balanced_quotas(utterances, 2 * total, IMPOSTOR_QUOTA, seed)
    n, least, extra = quotas.agg(F.count("*"), F.min("quota"), F.sum("quota") - F.min("quota") * F.count("*")).first()
    if n < 2:
        raise ValueError("impostor trials need two speakers")
    # Round 0 is that of the extra ones (none if all quotas are equal); rounds 1 to ``least`` hold every speaker.
    rounds = quotas.withColumn("round", F.explode(F.sequence(F.when(F.col("quota") > least, 0).otherwise(1), F.lit(least).cast("int")))) if least else quotas.where("quota > 0").withColumn("round", F.lit(0))
    ranked = digest_rank(rounds.withColumn("_d", stable_digest(seed, IMPOSTOR_SPEAKER, F.col("round"), F.col("speaker_id"))), "_d", "speaker_id", by=("round",))
    endpoint = F.when(F.col("round") == 0, F.col("rank")).otherwise(extra + (F.col("round") - 1) * n + F.col("rank"))
    ends = Scratch(utterances.sparkSession, "impostor-speakers").keep(ranked.select(endpoint.cast("long").alias("endpoint"), "round", "rank", "speaker_id"), "endpoints")

    # Borders between rounds within a pair: one row for each round.
    last = ends.where("endpoint % 2 = 0").select((F.col("endpoint") + 1).alias("endpoint"), F.col("speaker_id").alias("_last"))
    border = ends.where("rank = 0 and endpoint % 2 = 1").join(last, "endpoint").where("speaker_id = _last").select(F.col("round").alias("_round"))
    moved = F.when(F.col("_round").isNotNull() & (F.col("rank") < 2), 1 - 2 * F.col("rank")).otherwise(F.lit(0))
    placed = ends.join(border, F.col("round") == F.col("_round"), "left").select((F.col("endpoint") + moved).alias("endpoint"), "speaker_id")
    side = lambda k: F.max(F.when(F.col("endpoint") % 2 == k, F.col("speaker_id")))
    return placed.groupBy(F.expr("endpoint div 2").alias("position")).agg(side(0).alias("speaker_a"), side(1).alias("speaker_b"))


def impostor_trials(utterances: DataFrame, total: int, seed: int = SEED) -> DataFrame:
    """``COLUMNS`` and ``position``: for each pair of speakers an unseen pair of utterances, their uses balanced.

    The meetings of two speakers with n_a and n_b utterances walk along the shifted diagonals of their n_a x n_b grid:
    meeting m takes row m modulo n_a and column m + m div lcm(n_a, n_b) modulo n_b, which are distinct cells for all
    n_a n_b meetings.  Rows and columns are places in an order of digests, and begin where the speaker's meetings with its
    partners before (in an order of digests) have ended, so any two utterances of a speaker are used equally often, give or
    take one.  More meetings than a grid has cells are an error.
    """
    scratch = Scratch(utterances.sparkSession, "impostor-trials")
    pairs = scratch.keep(impostor_speaker_pairs(utterances, total, seed).select("position", F.least("speaker_a", "speaker_b").alias("low"), F.greatest("speaker_a", "speaker_b").alias("high")), "pairs")
    paths = utterances.select("speaker_id", "path").distinct()
    queue = digest_rank(paths.withColumn("_d", stable_digest(seed, IMPOSTOR, F.col("path"))), "_d", "path", name="place", by=("speaker_id",)).select("speaker_id", "place", "path")
    sizes = paths.groupBy("speaker_id").agg(F.count("*").alias("n"))

    meetings = scratch.keep(pairs.groupBy("low", "high").agg(F.count("*").alias("meetings")), "meetings")
    each = lambda own, other: meetings.select(F.col(own).alias("speaker_id"), F.col(other).alias("partner"), "meetings")
    partners = each("low", "high").unionByName(each("high", "low")).withColumn("_d", stable_digest(seed, IMPOSTOR, "partner", F.col("speaker_id"), F.col("partner")))
    begins = running_total(digest_rank(partners, "_d", "partner", name="turn", by=("speaker_id",)), F.col("meetings"), "turn", "begin", ("speaker_id",))
    sided = lambda own, other, x: begins.join(sizes, "speaker_id").select(F.col("speaker_id").alias(own), F.col("partner").alias(other), F.col("begin").alias(f"begin_{x}"), F.col("n").alias(f"n_{x}"))
    grids = meetings.join(sided("low", "high", "a"), ["low", "high"]).join(sided("high", "low", "b"), ["low", "high"])
    grids = scratch.keep(grids.withColumn("lcm", div(F.col("n_a") * F.col("n_b"), gcd(F.col("n_a"), F.col("n_b")))), "grids")
    if grids.where("meetings > n_a * n_b").take(1):
        raise ValueError("two speakers have no unseen pair left; take fewer trials")

    met = running_total(pairs, F.lit(1), "position", "m", ("low", "high")).join(grids, ["low", "high"])
    cells = met.select("position", "low", "high", F.expr("(begin_a + m) % n_a").alias("place_a"), F.expr("pmod(begin_b + m + m div lcm - meetings div lcm, n_b)").alias("place_b"))
    given = lambda own, x: queue.select(F.col("speaker_id").alias(own), F.col("place").alias(f"place_{x}"), F.struct("path", F.col("speaker_id").alias("speaker")).alias(x))
    chosen = cells.join(given("low", "a"), ["low", "place_a"]).join(given("high", "b"), ["high", "place_b"])
    sides = chosen.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), "position")
    return sides.select(F.col("l.path").alias("left_audio_path"), F.col("r.path").alias("right_audio_path"), F.col("l.speaker").alias("left_speaker_id"), F.col("r.speaker").alias("right_speaker_id"), F.lit(0).alias("target"), "position")


def paired_rounds(utterances: DataFrame, rounds: int, seed: int = SEED, drawn: bool = False) -> DataFrame:
    """Impostor trials at any scale: in each round the speakers, in the order of a fresh digest, pair up two by two.

    Every speaker takes part once a round (one sits out if their number is odd), so participation stays balanced; each
    gives an utterance chosen by digest rank, in turn or, if ``drawn``, at a place that a digest of the round draws, so
    that any two utterances can meet.  Repeated pairs are dropped.  ``COLUMNS`` and ``round``.
    """
    return _paired_rounds(utterances.select("speaker_id", "path").distinct(), rounds, seed, drawn)


def _paired_rounds(paths: DataFrame, rounds: int, seed: int, drawn: bool) -> DataFrame:
    """The same for rows (speaker_id, path) that are distinct."""
    owned = digest_rank(paths.withColumn("_d", stable_digest(seed, IMPOSTOR, F.col("path"))), "_d", "path", name="place", by=("speaker_id",)).select("speaker_id", "path", "place")
    sizes = owned.groupBy("speaker_id").agg(F.count("*").alias("n"))
    turns = _spread(sizes).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_d", stable_digest(seed, IMPOSTOR_SPEAKER, F.col("round"), F.col("speaker_id")))
    ranked = digest_rank(turns, "_d", "speaker_id", by=("round",))
    turn = F.conv(F.substring(stable_digest(seed, IMPOSTOR, F.col("round"), F.col("speaker_id")), 1, 15), 16, 10).cast("long") if drawn else F.col("round")
    picked = ranked.withColumn("place", turn % F.col("n")).join(owned.hint("merge"), ["speaker_id", "place"])  # ``ranked`` was exploded
    sides = picked.groupBy("round", F.floor(F.col("rank") / 2).alias("pair")).agg(F.count("*").alias("n"), F.min(F.struct("path", "speaker_id")).alias("l"), F.max(F.struct("path", "speaker_id")).alias("r")).where("n = 2")
    trials = sides.select(F.col("l.path").alias("left_audio_path"), F.col("r.path").alias("right_audio_path"), F.col("l.speaker_id").alias("left_speaker_id"), F.col("r.speaker_id").alias("right_speaker_id"), F.lit(0).alias("target"), "round")
    return trials.groupBy(*COLUMNS).agg(F.min("round").alias("round"))


def neighbour_trials(utterances: DataFrame, width: int, seed: int = SEED, bucket_rows: int = 4096) -> DataFrame:
    """Linear-size trials: each utterance with the next ``width`` ones in digest order.

    Genuine pairs are neighbours among the speaker's own utterances, impostor pairs neighbours of other speakers among
    all.  Both orders are cut into stretches of ``bucket_rows`` places, so no window grows with a speaker; the first
    ``width`` rows of a stretch also end the one before, so no pair is lost between them.  Rows without a speaker or a
    path take no part.  ``COLUMNS``.
    """
    paths = utterances.select("speaker_id", "path").dropna().distinct().withColumn("_d", stable_digest(seed, "neighbour", F.col("path")))
    span = max(bucket_rows, width)
    own = F.floor(F.col("_place") / span)

    def pairs(by: tuple[str, ...], keep: str, target: int) -> DataFrame:
        placed = digest_rank(paths, "_d", "path", "speaker_id", name="_place", by=by)
        leads = (F.col("_place") >= span) & (F.col("_place") % span < width)
        cut = placed.withColumn("_stretch", F.explode(F.when(leads, F.array(own - 1, own)).otherwise(F.array(own))))
        order = Window.partitionBy(*by, "_stretch").orderBy("_place")
        nexts = cut.withColumns({f"_n{k}": F.lead(F.struct("path", "speaker_id"), k).over(order) for k in range(1, width + 1)}).where(F.col("_stretch") == own)
        each = nexts.select("path", "speaker_id", F.explode(F.array(*[f"_n{k}" for k in range(1, width + 1)])).alias("o")).where(keep)
        a, b = F.struct("path", "speaker_id"), F.col("o")
        low, high = F.least(a, b), F.greatest(a, b)
        return each.select(low["path"].alias("left_audio_path"), high["path"].alias("right_audio_path"), low["speaker_id"].alias("left_speaker_id"), high["speaker_id"].alias("right_speaker_id"), F.lit(target).alias("target"))

    return pairs(("speaker_id",), "o is not null", 1).unionByName(pairs((), "o is not null and o.speaker_id != speaker_id", 0))


def _spread(speakers: DataFrame) -> DataFrame:
    """Speakers whose small rows are about to become many, over all cores: dealt out by their bytes, few tasks had all work."""
    return speakers.repartition(2 * speakers.sparkSession.sparkContext.defaultParallelism, "speaker_id")


def drawn_pairs(utterances: DataFrame, cap: int, seed: int = SEED) -> DataFrame:
    """``cap`` different pairs of utterances of each speaker (all of them if it has no more), drawn from all its pairs.

    The pairs of n utterances are numbered; a keyed permutation of the numbers gives the first ``cap`` of a shuffled order
    one by one, and a number gives its two places in an order of digests.  No other pair is ever formed, so the work is in
    proportion to utterances and pairs drawn.  ``COLUMNS``.
    """
    return _drawn_pairs(utterances.select("speaker_id", "path").distinct(), cap, seed)


def _drawn_pairs(paths: DataFrame, cap: int, seed: int) -> DataFrame:
    """The same for rows (speaker_id, path) that are distinct."""
    owned = digest_rank(paths.withColumn("_d", stable_digest(seed, GENUINE, F.col("path"))), "_d", "path", name="place", by=("speaker_id",)).select("speaker_id", "place", "path")
    sizes = paths.groupBy("speaker_id").agg(F.count("*").alias("n")).withColumn("pairs", F.shiftright(F.col("n") * (F.col("n") - 1), 1)).where("pairs > 0")
    drawn = _spread(sizes).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(cap).cast("long"), F.col("pairs")) - 1)))
    number = drawn.select("speaker_id", keyed_permutation(F.col("k"), F.col("pairs"), seed, GENUINE, F.col("speaker_id")).alias("number"))
    i, j = pair_of(F.col("number"))
    places = number.select("speaker_id", i.alias("i"), j.alias("j"))
    # Merged, since Spark sizes the exploded numbers by the speakers that they come from, and would broadcast them.
    at = lambda name, path: owned.select("speaker_id", F.col("place").alias(name), F.col("path").alias(path)).hint("merge")
    both = places.join(at("i", "_a"), ["speaker_id", "i"]).join(at("j", "_b"), ["speaker_id", "j"])
    return both.select(F.least("_a", "_b").alias("left_audio_path"), F.greatest("_a", "_b").alias("right_audio_path"), F.col("speaker_id").alias("left_speaker_id"), F.col("speaker_id").alias("right_speaker_id"), F.lit(1).alias("target"))


def legacy_trials(utterances: DataFrame, cap: int = 100, seed: int = SEED) -> DataFrame:
    """Up to ``cap`` genuine pairs of each speaker and as many impostor pairs of balanced participation, in mixed order.

    Genuine pairs are drawn from all pairs of a speaker (``drawn_pairs``).  Impostor rounds are added until there are
    enough of them.  The shuffles are keyed permutations and digest orders (reproducible on any number of machines) instead
    of one generator's stream.  ``trial_id`` counts from 0 in the order of a digest; speakers need two utterances or more.
    """
    scratch = Scratch(utterances.sparkSession, "legacy-trials")
    paths = scratch.keep(utterances.select("speaker_id", "path").distinct(), "paths")
    sizes = paths.groupBy("speaker_id").agg(F.count("*").alias("n"))
    if sizes.where("n < 2").take(1):
        raise ValueError("every speaker needs two utterances")
    genuine = scratch.keep(_drawn_pairs(paths, cap, seed), "genuine")
    needed = genuine.count()
    speakers, cross = sizes.agg(F.count("*"), (F.sum("n").cast("double") ** 2 - F.sum(F.col("n").cast("double") ** 2)) / 2).first()
    if needed and cross < needed:
        raise ValueError("the speakers cannot supply enough impostor pairs")
    rounds = -(-needed // max(1, speakers // 2)) + 2
    while True:
        made = scratch.keep(_paired_rounds(paths, rounds, seed, drawn=True), "impostor")
        if made.count() >= needed:
            break
        if rounds > 1000 * needed:
            raise ValueError("the speakers did not supply enough impostor pairs")
        scratch.drop(made)
        rounds *= 2
    made = made.withColumn("_d", stable_digest(seed, IMPOSTOR, "order", F.col("left_audio_path"), F.col("right_audio_path")))
    before = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)  # one row a round
    offsets = made.groupBy("round").agg(F.count("*").alias("_n")).select("round", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    impostor = digest_rank(made, "_d", by=("round",)).join(F.broadcast(offsets), "round").where(F.col("_before") + F.col("rank") < needed).select(*COLUMNS)
    # Ranks read their rows twice; written once, these are not chosen and ranked again for it.
    both = scratch.keep(genuine.unionByName(impostor), "both").withColumn("_d", stable_digest(seed, "mixed", F.col("left_audio_path"), F.col("right_audio_path")))
    return digest_rank(both, "_d", "left_audio_path", "right_audio_path", name="trial_id").select("trial_id", "target", *COLUMNS[:4])


def with_trial_ids(genuine: DataFrame, impostor: DataFrame, prefix: str) -> DataFrame:
    """Genuine trials (by speaker, then digest) before impostor trials (by position), numbered and padded."""
    both = genuine.select(*COLUMNS, F.col("left_speaker_id").alias("_s"), "digest", F.lit(0).alias("position")).unionByName(impostor.select(*COLUMNS, F.lit("").alias("_s"), F.lit("").alias("digest"), "position"))
    ranked = ordered_rank(both, [F.desc("target"), F.col("_s"), F.col("digest"), F.col("position")], "_n", "trial-ids")
    return ranked.select(numbered(prefix, F.col("_n")).alias("trial_id"), *COLUMNS)


def participation(trials: DataFrame) -> DataFrame:
    """Rows (speaker_id, genuine_trials, impostor_endpoints)."""
    ends = trials.select("target", F.explode(F.when(F.col("target") == 1, F.array("left_speaker_id")).otherwise(F.array("left_speaker_id", "right_speaker_id"))).alias("speaker_id"))
    return ends.groupBy("speaker_id").agg(F.count_if(F.col("target") == 1).alias("genuine_trials"), F.count_if(F.col("target") == 0).alias("impostor_endpoints"))


def trial_violations(trials: DataFrame, utterances: DataFrame) -> DataFrame:
    """Ids unique, pairs unordered-unique and not of one path, both paths known and owned as declared, targets right, every
    speaker represented, as many genuine as impostor trials.

    The trials are written once, so whatever made them runs once and not for each rule.  Ids and pairs that occur twice are
    looked for among 64-bit hashes; only rows whose hash occurs twice are compared as texts.
    """
    trials = Scratch(trials.sparkSession, "trial-violations").keep(trials, "trials")
    owners = utterances.select("path", F.col("speaker_id").alias("owner")).distinct()
    joined = trials.join(owners.withColumnsRenamed({"path": "left_audio_path", "owner": "_l"}), "left_audio_path", "left").join(owners.withColumnsRenamed({"path": "right_audio_path", "owner": "_r"}), "right_audio_path", "left")
    key = F.col("trial_id")

    def repeated(rule: str, text: Column) -> DataFrame:
        hashed = trials.select(F.xxhash64(text).alias("_h"), text.alias("_text"))
        twice = hashed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
        return duplicates(hashed.join(twice, "_h", "left_semi"), rule, F.col("_text"))

    seen = trials.select(F.explode(F.array("left_speaker_id", "right_speaker_id")).alias("speaker_id")).distinct()
    counts = trials.agg(F.count_if(F.col("target") == 1).alias("g"), F.count_if(F.col("target") == 0).alias("i"))
    return all_of(
        repeated("unique_id", key),
        repeated("unique_pair", F.concat_ws(" ", F.least("left_audio_path", "right_audio_path"), F.greatest("left_audio_path", "right_audio_path"))),
        violations(trials, "self_pair", key, F.col("left_audio_path") == F.col("right_audio_path")),
        row_violations(
            joined, key,
            ("known_path", F.col("_l").isNull() | F.col("_r").isNull()),
            ("declared_owner", F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.coalesce((F.col("_l") != F.col("left_speaker_id")) | (F.col("_r") != F.col("right_speaker_id")), F.lit(True))),
        ),
        row_violations(
            trials, key,
            ("target_value", ~F.col("target").isin(0, 1)),
            ("target_is_same_speaker", (F.col("target") == 1) != (F.col("left_speaker_id") == F.col("right_speaker_id"))),
        ),
        violations(owners.select(F.col("owner").alias("speaker_id")).distinct().join(seen, "speaker_id", "left_anti"), "represented_speaker", F.col("speaker_id"), F.lit(True)),
        violations(counts, "balanced_targets", F.lit("counts"), F.col("g") != F.col("i")),
    )


def contiguous_violations(trials: DataFrame) -> DataFrame:
    """Integer trial ids that do not run from 0 without gaps."""
    span = trials.agg(F.count("*").alias("n"), F.countDistinct("trial_id").alias("d"), F.coalesce(F.min("trial_id"), F.lit(0)).alias("lo"), F.coalesce(F.max("trial_id"), F.lit(-1)).alias("hi"))
    return violations(span, "contiguous_ids", F.lit("trials"), (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n")), F.col("n"))
