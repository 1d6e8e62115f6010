"""Agreement between runs on the parcels they flag, the contacts they pick and the losses they report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landledger.plans.skew import dense_rank
from landledger.plans.stages import Stages

# Ranks are cut into blocks of this many for the prefix sums behind Kendall's tau.
BLOCK = 1024


def load_artifacts(raw: DataFrame) -> DataFrame:
    """(run, cod_imovel, loss, contact): blank ids dropped, unreadable losses zero, the last row of an id wins.

    ``raw`` has run, arrival, cod_imovel, loss and contact as text. The last row is a max over
    (arrival, row), combined map-side.
    """
    cleaned = raw.select(
        "run", F.trim("cod_imovel").alias("cod_imovel"),
        F.struct(
            "arrival",
            F.coalesce(F.trim("loss").try_cast("double"), F.lit(0.0)).alias("loss"),
            F.trim(F.coalesce("contact", F.lit(""))).alias("contact"),
        ).alias("last"),
    ).filter(F.coalesce("cod_imovel", F.lit("")) != "")
    return cleaned.groupBy("run", "cod_imovel").agg(F.max("last").alias("last")).select(
        "run", "cod_imovel", "last.loss", "last.contact"
    )


def _run_count(artifacts: DataFrame):
    return artifacts.agg(F.count_distinct("run")).scalar()


def run_patterns(artifacts: DataFrame) -> DataFrame:
    """How many parcels were flagged by exactly each set of runs; far fewer rows than parcels."""
    per_parcel = artifacts.groupBy("cod_imovel").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    return per_parcel.groupBy("runs").agg(F.count("*").alias("parcels"))


def pairwise_jaccard(artifacts: DataFrame) -> DataFrame:
    """(run_a, run_b, jaccard) for every pair of runs, from the flag patterns."""
    patterns = run_patterns(artifacts)
    both = patterns.select(
        "parcels",
        F.explode(
            F.flatten(
                F.transform(
                    "runs",
                    lambda a: F.transform(
                        F.filter("runs", lambda b: b > a), lambda b: F.struct(a.alias("run_a"), b.alias("run_b"))
                    ),
                )
            )
        ).alias("pair"),
    ).groupBy("pair.run_a", "pair.run_b").agg(F.sum("parcels").alias("shared"))
    size = artifacts.groupBy("run").agg(F.count("*").alias("flags"))
    a = size.select(F.col("run").alias("run_a"), F.col("flags").alias("flags_a"))
    b = size.select(F.col("run").alias("run_b"), F.col("flags").alias("flags_b"))
    every_run = size.agg(F.array_sort(F.collect_set("run"))).scalar()  # one name per run
    later = F.explode(F.filter("_runs", lambda r: r > F.col("run_a")))
    pairs = a.withColumn("_runs", every_run).withColumn("run_b", later).drop("_runs")
    pairs = pairs.join(b, "run_b").join(both, ["run_a", "run_b"], "left")
    shared = F.coalesce("shared", F.lit(0))
    union = F.col("flags_a") + F.col("flags_b") - shared
    return pairs.select("run_a", "run_b", F.when(union == 0, 1.0).otherwise(shared / union).alias("jaccard"))


def flag_jaccard(artifacts: DataFrame) -> DataFrame:
    """Mean over run pairs; a single run agrees with itself."""
    return pairwise_jaccard(artifacts).agg(F.coalesce(F.avg("jaccard"), F.lit(1.0)).alias("flag_jaccard"))


def unstable_parcels(artifacts: DataFrame) -> DataFrame:
    """Parcels flagged by some runs but not by all."""
    per = artifacts.groupBy("cod_imovel").agg(F.count_distinct("run").alias("n_runs"))
    return per.filter(F.col("n_runs") < _run_count(artifacts))


def shared_rows(artifacts: DataFrame) -> DataFrame:
    """Rows of the parcels every run flagged."""
    per = artifacts.groupBy("cod_imovel").agg(F.count_distinct("run").alias("n_runs"))
    everywhere = per.filter(F.col("n_runs") == _run_count(artifacts)).select("cod_imovel")
    return artifacts.join(everywhere, "cod_imovel", "left_semi")


def kendall_tau(artifacts: DataFrame, stages: Stages, block: int = BLOCK) -> DataFrame:
    """(run_a, run_b, tau) of the loss rankings on shared parcels.

    No pairs of parcels are formed. Losses become dense ranks; discordant pairs are counted
    bit by bit: a pair whose second ranks first differ at bit b, with equal higher bits,
    is discordant when the parcel with the 1 comes earlier in the first ranking. That is a
    prefix sum over first ranks, taken in blocks so that no window holds a whole run.
    Ties on both sides count in both tie terms.
    """
    shared = stages.keep("shared_artifacts", shared_rows(artifacts))
    ranked = shared.join(dense_rank(shared, ["run"], "loss"), ["run", "loss"]).select("cod_imovel", "run", "position")
    per_parcel = ranked.groupBy("cod_imovel").agg(F.array_sort(F.collect_list(F.struct("run", "position"))).alias("runs"))
    points = (
        per_parcel.select(
            F.explode(
                F.flatten(
                    F.transform(
                        "runs",
                        lambda a: F.transform(
                            F.filter("runs", lambda b: b["run"] > a["run"]),
                            lambda b: F.struct(
                                a["run"].alias("run_a"), b["run"].alias("run_b"),
                                a["position"].alias("x"), b["position"].alias("y"),
                            ),
                        ),
                    )
                )
            ).alias("p")
        )
        .groupBy("p.run_a", "p.run_b", "p.x", "p.y")
        .agg(F.count("*").alias("w"))
    )
    points = stages.keep("rank_points", points)
    pair = ["run_a", "run_b"]

    def pairs_of(count: Column) -> Column:
        return count * (count - 1) / 2

    # Ties: groups of equal x, of equal y, and of both, in one pass over the points.
    ties = (
        points.groupingSets([[*pair, "x"], [*pair, "y"], [*pair, "x", "y"]], *pair, "x", "y")
        .agg(F.sum("w").alias("n"), F.grouping_id().alias("_set"))
        .groupBy(*pair)
        .agg(
            *[
                F.sum(F.when(F.col("_set") == code, pairs_of(F.col("n"))).otherwise(0)).alias(name)
                for code, name in ((1, "tx"), (2, "ty"), (0, "txy"))
            ],
            F.sum(F.when(F.col("_set") == 0, F.col("n")).otherwise(0)).alias("n"),
        )
    )

    top_bit = points.agg(F.ceil(F.log2(F.max("y") + 1)).cast("int")).scalar()
    bits = points.withColumn("bit", F.explode(F.sequence(F.lit(0), F.greatest(top_bit, F.lit(1)) - 1)))
    step = F.pow(F.lit(2.0), F.col("bit")).cast("bigint")
    steps = (
        bits.withColumn("is_one", F.floor(F.col("y") / step) % 2 == 1)
        .withColumn("prefix", F.floor(F.col("y") / (step * 2)))
        .groupBy(*pair, "bit", "prefix", "x")
        .agg(
            F.sum(F.when(F.col("is_one"), F.col("w")).otherwise(0)).alias("ones"),
            F.sum(F.when(F.col("is_one"), 0).otherwise(F.col("w"))).alias("zeros"),
        )
        .withColumn("block", F.floor(F.col("x") / block))
    )
    cell = [*pair, "bit", "prefix"]
    blocks = steps.groupBy(*cell, "block").agg(F.sum("ones").alias("block_ones"))
    earlier = Window.partitionBy(*cell).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*cell, "block", F.coalesce(F.sum("block_ones").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*cell, "block").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    discordant = (
        steps.withColumn("before", F.coalesce(F.sum("ones").over(within), F.lit(0)))
        .join(offsets, [*cell, "block"])
        .groupBy(*pair)
        .agg(F.sum(F.col("zeros") * (F.col("before") + F.col("offset"))).alias("discordant"))
    )
    counts = ties.join(discordant, pair)
    n = F.col("n")
    decided = n * (n - 1) / 2 - F.col("tx") - F.col("ty") + F.col("txy")
    denominator = F.sqrt((decided + F.col("tx")) * (decided + F.col("ty")))
    return counts.select(
        *pair, F.when(n >= 2, F.try_divide(decided - 2 * F.col("discordant"), denominator)).alias("tau")
    )


def ranking_tau(artifacts: DataFrame, stages: Stages) -> DataFrame:
    return kendall_tau(artifacts, stages).agg(F.avg("tau").alias("ranking_tau"))


def _choices(shared: DataFrame) -> DataFrame:
    return shared.groupBy("cod_imovel", "contact").agg(F.count("*").alias("votes"))


def contact_kappa(artifacts: DataFrame) -> DataFrame:
    """Fleiss' kappa of the chosen contacts over shared parcels."""
    votes = _choices(shared_rows(artifacts))
    v = F.col("votes")
    per_parcel = votes.groupBy("cod_imovel").agg(
        F.sum("votes").alias("raters"), F.sum(v * (v - 1)).alias("agree")
    )
    observed = per_parcel.agg(
        F.struct(
            F.max("raters").alias("raters"),
            F.avg(F.try_divide(F.col("agree"), F.col("raters") * (F.col("raters") - 1))).alias("p_bar"),
        )
    ).scalar()
    per_contact = votes.groupBy("contact").agg(F.sum("votes").cast("double").alias("picked"))
    total = per_contact.agg(F.sum("picked")).scalar()
    share = F.col("picked") / total
    chance = per_contact.agg(
        F.count("*").alias("categories"), F.sum(share * share).alias("p_e"),
    )
    p_bar, p_e = observed["p_bar"], F.col("p_e")
    return chance.select(
        F.when((F.col("categories") == 0) | (observed["raters"] < 2), F.lit(None).cast("double"))
        .when((F.col("categories") < 2) | (p_e >= 1), 1.0)
        .otherwise((p_bar - p_e) / (1 - p_e))
        .alias("contact_kappa")
    )


def contact_agreement(artifacts: DataFrame) -> DataFrame:
    """Share of runs behind the most common contact, averaged over shared parcels."""
    per = _choices(shared_rows(artifacts)).groupBy("cod_imovel").agg(
        (F.max("votes") / F.sum("votes")).alias("modal_share")
    )
    return per.agg(F.avg("modal_share").alias("contact_agreement"))


def loss_variation(artifacts: DataFrame) -> DataFrame:
    """Population coefficient of variation of the loss per shared parcel; a zero mean has none."""
    per = shared_rows(artifacts).groupBy("cod_imovel").agg(
        F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("spread")
    )
    return per.filter(F.col("mean") != 0).select("cod_imovel", (F.col("spread") / F.col("mean")).alias("loss_cv"))


def oracle_agreement(artifacts: DataFrame, oracle: DataFrame) -> DataFrame:
    """Per run against the golden artifact: flagged-set Jaccard and share of its contacts hit."""
    golden = oracle.select("cod_imovel", F.col("contact").alias("golden_contact"))
    n_golden = golden.agg(F.count("*")).scalar()
    joined = artifacts.join(golden, "cod_imovel", "left")
    per = joined.groupBy("run").agg(
        F.count("*").alias("flags"),
        F.count("golden_contact").alias("shared"),
        F.count_if(F.col("contact") == F.col("golden_contact")).alias("hits"),
    )
    return per.select(
        "run",
        (F.col("shared") / (F.col("flags") + n_golden - F.col("shared"))).alias("flag_jaccard"),
        F.try_divide(F.col("hits"), n_golden).alias("contact_agreement"),
    )


def consistency(artifacts: DataFrame, oracle: DataFrame, stages: Stages) -> DataFrame:
    """The one-row agreement report."""
    against = oracle_agreement(artifacts, oracle).agg(
        F.struct(F.avg("flag_jaccard").alias("flag_jaccard"), F.avg("contact_agreement").alias("contact_agreement"))
    ).scalar()
    return artifacts.agg(F.count_distinct("run").alias("n_runs")).select(
        "n_runs",
        flag_jaccard(artifacts).scalar().alias("flag_jaccard"),
        ranking_tau(artifacts, stages).scalar().alias("ranking_tau"),
        contact_agreement(artifacts).scalar().alias("contact_agreement"),
        contact_kappa(artifacts).scalar().alias("contact_kappa"),
        against["flag_jaccard"].alias("oracle_flag_jaccard"),
        against["contact_agreement"].alias("oracle_contact_agreement"),
    )
