"""Refinement loops replayed from recorded rounds (L1-L9): gates, acceptance, stops, directives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.style import WEIGHTS

GATES = ["length", "preservation", "phrases", "structure", "copy"]


def first_failing(gates: DataFrame) -> DataFrame:
    """L1: add ``reason``: the first gate in order that failed, else null.  Columns: one boolean a gate."""
    reason = F.coalesce(*[F.when(~F.col(g), F.lit(g)) for g in GATES])
    return gates.withColumn("reason", reason)


def best_survivors(candidates: DataFrame, run: str = "run", round_: str = "iteration") -> DataFrame:
    """L2: per round the survivor with the lowest (dev score, name): ``run, iteration, best, dev, a``; null without one."""
    alive = F.col("reason").isNull()
    best = F.min(F.when(alive, F.struct(F.col("dev_score").alias("dev"), F.col("name").alias("name"), F.col("a_score").alias("a"))))
    rows = candidates.groupBy(run, round_).agg(best.alias("b"))
    return rows.select(run, round_, F.col("b")["name"].alias("best"), F.col("b")["dev"].alias("dev"), F.col("b")["a"].alias("a"))


def replay(rounds: DataFrame, patience: int = 2, min_delta: float = 0.01, run: str = "run", round_: str = "iteration") -> DataFrame:
    """L2-L4: adds ``accepted, best_score, divergence_run, since_accept, stop`` to each round, up to the one that stops.

    A run has few rounds, so its rounds are one array and the loop is a fold
    over it (acceptance depends on what was accepted before).
    """
    rows = rounds.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(round_).alias("i"), "best", "dev", "a"))).alias("rs"))
    empty = "array<struct<i:bigint,best:string,dev:double,a:double,accepted:boolean,best_score:double,divergence_run:int,since_accept:int,stop:string>>"
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("score"), none.alias("pd"), none.alias("pa"), F.lit(0).alias("div"), F.lit(0).alias("wait"), F.lit(None).cast("string").alias("stop"), F.array().cast(empty).alias("out"))

    def step(s, r):
        alive = r["dev"].isNotNull()
        accepted = alive & (s["score"].isNull() | (r["dev"] <= s["score"] - min_delta))
        score = F.when(accepted, r["dev"]).otherwise(s["score"])
        drifts = F.coalesce(alive & (r["a"] < s["pa"]) & (r["dev"] > s["pd"]), F.lit(False))
        div = F.when(drifts, s["div"] + 1).otherwise(0)
        wait = F.when(accepted, 0).otherwise(s["wait"] + 1)
        stop = F.when(div >= 2, "divergence").when(wait >= patience, "patience")
        row = F.struct(r["i"].cast("bigint").alias("i"), r["best"].alias("best"), r["dev"].alias("dev"), r["a"].alias("a"), accepted.alias("accepted"), score.alias("best_score"), div.alias("divergence_run"), wait.alias("since_accept"), stop.alias("stop"))
        done = s["stop"].isNotNull()
        return F.struct(
            F.when(done, s["score"]).otherwise(score).alias("score"),
            F.when(done, s["pd"]).otherwise(F.coalesce(r["dev"], s["pd"])).alias("pd"),
            F.when(done, s["pa"]).otherwise(F.coalesce(r["a"], s["pa"])).alias("pa"),
            F.when(done, s["div"]).otherwise(div).alias("div"),
            F.when(done, s["wait"]).otherwise(wait).alias("wait"),
            F.when(done, s["stop"]).otherwise(stop).alias("stop"),
            F.when(done, s["out"]).otherwise(F.concat(s["out"], F.array(row))).cast(empty).alias("out"),
        )

    folded = rows.select(run, F.aggregate("rs", start, step).alias("s"))
    out = folded.select(run, F.coalesce(F.col("s")["stop"], F.lit("max_iterations")).alias("stop_reason"), F.inline(F.col("s")["out"]))
    return out.withColumnRenamed("i", round_)


def running_best(rounds: DataFrame, run: str = "run", round_: str = "iteration") -> DataFrame:
    """Lowest dev score up to each round, and whether the round improved on all before: windows only."""
    before = Window.partitionBy(run).orderBy(round_).rowsBetween(Window.unboundedPreceding, -1)
    return rounds.withColumn("best_before", F.min("dev").over(before)).withColumn("improved", F.col("best_before").isNull() | (F.col("dev") < F.col("best_before")))


def directives(distances: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` largest weighted distances of each candidate, ties by name."""
    w = F.broadcast(distances.sparkSession.createDataFrame(list(WEIGHTS.items()), "feature string, weight double"))
    rows = distances.join(w, "feature").withColumn("weighted", F.col("distance") * F.col("weight"))
    rank = F.row_number().over(Window.partitionBy("profile", "candidate").orderBy(F.desc("weighted"), "feature"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def baseline_samples(nearest: DataFrame, mode: str, k: int = 2) -> DataFrame:
    """No sample, the first ``k`` by name, or the nearest ``k`` (``rank``) of each candidate."""
    if mode == "zero":
        return nearest.limit(0)
    if mode == "nearest":
        return nearest.where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy("sample"))
    return nearest.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def climb_violations(scanned: DataFrame) -> DataFrame:
    """Add ``violation_count`` to rows with ``structure`` and ``silhouette``: structure flags, and metric flags (one at least where the penalty is reached)."""
    metric = F.size(F.filter(F.col("silhouette")["flags"], lambda f: f["metric"] != "silhouette_penalty"))
    dirty = F.coalesce(F.col("silhouette")["penalty"] >= 1.0, F.lit(False))
    n = F.size(F.col("structure")["flags"]) + F.when(dirty, F.greatest(metric, F.lit(1))).otherwise(0)
    return scanned.withColumn("violation_count", n)


# What a climb round is told, by finding; braces take the value.
DIRECTIVES = {
    "sentence_burstiness": "Vary sentence lengths: their variation is {value}, under 0.55.",
    "conclusion_coda": "Cut the closing recap; end on a concrete fact.",
    "bold_colon_listicle": "Turn {value} bold-label lines into prose.",
    "one_line_staccato": "Merge one-sentence paragraphs: they are {value} of all.",
    "connective_paragraph_openers": "Reopen {value} paragraphs without a connective.",
    "every_template_openers": "Reopen {value} paragraphs that start 'Every ...'.",
    "signpost_density": "Remove roadmap phrases: {value} per 100 words.",
    "opener_repetition": "Vary sentence openers: only {value} are distinct.",
    "participial_closer_share": "Cut -ing tails: {value} of the sentences end on one.",
    "scaffold_opener_share": "Open body paragraphs on their claim: {value} open on a cue.",
    "role_entropy_bits": "Stop rotating scaffold openers ({value} bits).",
    "heading_preview": "Let headings carry new ground: {value} restate the intro.",
    "preview_fulfillment": "Drop the preview: {value} of the body fulfils it.",
    "callback_content": "Don't loop back to opening words ({value} per paragraph).",
    "silhouette_penalty": "Rearrange around the argument: penalty {value}.",
}


def climb_directives(flags: DataFrame) -> DataFrame:
    """``metric, value`` rows with the directive for each, by a join with the templates."""
    table = F.broadcast(flags.sparkSession.createDataFrame(list(DIRECTIVES.items()), "metric string, template string"))
    return flags.join(table, "metric").withColumn("directive", F.replace("template", F.lit("{value}"), F.round("value", 3).cast("string"))).drop("template")


def terminal_state(rounds: DataFrame, max_rounds: int = 4, run: str = "run", round_: str = "round") -> DataFrame:
    """``run, state, rounds``: the first round that loses a fact or is clean decides, else ``capped``."""
    ends = F.when(~F.col("preserved"), "preservation_violation").when(F.col("violation_count") == 0, "converged")
    rows = rounds.where(F.col(round_) < max_rounds).withColumn("end", ends)
    first = F.min(F.when(F.col("end").isNotNull(), F.struct(F.col(round_).alias("r"), "end")))
    return rows.groupBy(run).agg(first.alias("f"), F.max(round_).alias("last")).select(run, F.coalesce(F.col("f")["end"], F.lit("capped")).alias("state"), (F.coalesce(F.col("f")["r"], F.col("last")) + 1).alias("rounds"))
