"""The whole analysis of runs, from a grid to verdicts: every stage reads what the stages before it found.

Time is counted from the end of each run's own baseline, so that one job serves runs with different baselines: t < 0 is the baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import drift, faults, health, packed as p, relations, signals
from tideline.operators.kernels import KEYS
from tideline.session import durable

#: Least correlation of a relation, and of sensors that measure the same; CUSUM slack; limit of the largest deviation, in sigmas.
RELATION_RHO, SAME_RHO, SLACK, FAR = 0.5, 0.95, 0.5, 3.0
#: A deviation that follows the level this closely is a gain.
GAIN_RHO = 0.5


def block_size(n: int, day: int = 0) -> int:
    """Steps of a drift block: a day if it has 20 steps or more, else a 200th of the run."""
    return day if day >= 20 else max(1, n // 200)


def baselines(ends: DataFrame, packed: DataFrame, points: DataFrame, n: int, sensors: int, size: int) -> DataFrame:
    """``run_id, from, to``: up to the first change that counts, and before a sensor that fails from inside it to the end."""
    outer = ends.select("run_id", "episode", F.explode(F.array("a", F.col("b") - 1)).alias("t"))  # first and last steps stand for all
    chosen = durable(signals.select_baseline(outer, signals.change_groups(p.changes(packed, points), n, sensors)))
    since = p.shifted(packed.join(F.broadcast(chosen), "run_id"), "from", "from").withColumn("length", F.col("to") - F.col("from"))  # a row for each run
    stats = durable(p.health_blocks(since.select(*KEYS, "s", F.floor(F.col("length") / 2).alias("end")), size))
    lengths = chosen.select("run_id", (F.col("to") - F.col("from")).alias("end"))
    bound = signals.bound_by_checks(health.checked(stats, p.health_reference(stats)), lengths).select("run_id", F.col("to").alias("length"))
    return durable(chosen.join(bound, "run_id").select("run_id", "from", (F.col("from") + F.col("length")).alias("to")))


def learned_relations(found: DataFrame) -> DataFrame:
    """``run_id, a, b, rho, lag, rho_at_lag``: the lag is 0 unless it correlates clearly better."""
    leads = (F.col("lag") != 0) & (F.abs("rho_at_lag") > F.abs("at_zero") + 0.02)
    return found.select("run_id", "a", "b", "rho", F.when(leads, F.col("lag")).otherwise(0).alias("lag"), F.when(leads, F.col("rho_at_lag")).otherwise(F.col("rho")).alias("rho_at_lag"), "at_zero")


def edges_of(found: DataFrame) -> DataFrame:
    ahead = F.col("lag") > 0
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    return found.where("lag <> 0").select("run_id", pick("a", "b").alias("source"), pick("b", "a").alias("target"), F.abs("lag").alias("lag"), F.col("rho_at_lag").alias("rho"), "at_zero")


def analyse(grid: DataFrame, family: Column, most_lag: int = 32, day: int = 0) -> dict[str, DataFrame]:
    """``run_id, sensor, episode, t, v`` to the tables of every stage; ``family`` (of ``sensor``) groups siblings, ``day`` is a day in steps.

    Runs are bucketed to grids of one size; block sizes follow the longest. Nulls are missing samples. Repeated samples of a step, and a
    run without samples after its baseline, give no incident of their own.
    """
    packed = durable(p.pack(grid.select(*KEYS, "episode", "t", "v")))
    ends = durable(p.episode_ends(packed))
    n, sensors = (int(x or 1) for x in ends.groupBy("run_id").agg((F.max("b") - F.min("a")).alias("n"), F.count_distinct("sensor").alias("sensors")).agg(F.max("n"), F.max("sensors")).head())  # two numbers
    size, block, fine = max(64, min(1024, n // 64)), block_size(n, day), max(1, n // 200)

    points = durable(p.change_points(packed, durable(p.run_spans(ends))))
    baseline = baselines(ends, packed, points, n, sensors, size)
    x = p.shifted(packed.join(F.broadcast(baseline), "run_id"), "from", "to").select(*KEYS, "s", F.lit(0).alias("end"))  # a row for each run

    stats = durable(p.health_blocks(x, size))
    checks = durable(health.suppressed(health.checked(stats, p.health_reference(stats))))
    gates = durable(health.gate(checks))
    failed = gates.where("health <> 'healthy'")
    x = durable(p.masked(x, checks.where("failed and part = 1").select(*KEYS, "part", "block").distinct(), size))

    found = durable(learned_relations(p.relations(x, RELATION_RHO, most_lag)))
    edges, level = durable(edges_of(found)), durable(found.where("lag = 0").select("run_id", "a", "b", "rho"))
    groups = durable(relations.redundancy_groups(level, SAME_RHO))
    prints = durable(p.fingerprints(x, until=0).where("n > 0"))
    scores = relations.role_scores(prints.drop("range_per_mad", "step"), prints.select(*KEYS, "range_per_mad"), edges, found, groups)
    roles = durable(relations.assign_roles(scores))

    peers = durable(relations.peers(found, failed))
    moved = durable(p.deviations(x, peers))
    models = moved.where("model is not null").select(*KEYS, "sigma", F.inline("model"))
    sweep = p.choose_drift(p.drift_sweep(moved, n, block, fine, FAR))
    slack, limit = sweep.where("chosen").select("slack", "limit").head() or (SLACK, p.LIMITS[-1])  # two numbers
    trends = p.block_trends(moved, slack, limit, block, fine).where(F.col("max_deviation").isNotNull())
    decided = durable(trends.withColumn("drifting", (F.col("max_deviation") >= FAR) & ((F.col("p") < 0.01) | F.col("alarm").isNotNull())))
    suspects = durable(decided.where("drifting").join(models.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS))
    refit = p.refits(x, peers, suspects, FAR / 2)
    blamed = durable(drift.responsible(peers, refit))
    # a victim's deviation halves at least without the one that explains it
    before = p.median_deviation(moved).select("run_id", F.col("sensor").alias("peer"), "before")
    eased = refit.join(before, ["run_id", "peer"]).withColumn("flat", F.col("flat") & (F.col("typical") < F.col("before") / 2)).drop("before")
    victims = durable(drift.victims(decided, eased, blamed))
    incidents = separate(x, moved, decided, victims, models, found, groups, roles, points.join(baseline, "run_id").select(*KEYS, (F.col("cut_t") - F.col("to")).alias("cut_t")), family, n, sensors, block, p.components(x.join(failed.select(*KEYS), KEYS, "left_anti"), 0))
    # times of incidents are counted from the start of the run again
    incidents = incidents.join(baseline, "run_id").withColumn("onset", F.col("onset") + F.col("to")).drop("from", "to")
    sick = failed.join(baseline, "run_id").select(
        "run_id", F.array("sensor").alias("drivers"), faults.fault_of_health(F.col("health")).alias("fault"), (F.col("from_block") + F.col("to")).alias("onset"), F.lit(0).cast("long").alias("n_victims"), "confidence"
    )
    both = incidents.unionByName(sick).withColumns({"label": faults.label_of(F.col("fault")), "family": faults.family_of(F.col("fault"))})
    return {"sweep": sweep, "baseline": baseline, "health": gates, "relations": found, "roles": roles, "peers": peers, "models": models, "drift": decided, "victims": victims, "incidents": durable(both)}


def separate(x: DataFrame, moved: DataFrame, decided: DataFrame, victims: DataFrame, models: DataFrame, found: DataFrame, groups: DataFrame, roles: DataFrame, points: DataFrame, family: Column, n: int, sensors: int, block: int, model: DataFrame) -> DataFrame:
    """One row for each group of drivers: its members, fault, onset, number of victims and confidence.

    A lone member of a redundancy group is certain to 0.9; else the confidence is how far the squared error and T2 of the run's principal components, each by its
    limit, lie apart while the group lasts; 0.5 without components.
    """
    blame = victims.select("run_id", F.col("victim").alias("sensor"), F.col("driver").alias("victim_of"))
    moving = durable(decided.join(blame, KEYS, "left").select(*KEYS, family.alias("family"), "drifting", F.coalesce("onset", F.lit(0)).cast("long").alias("onset"), "max_deviation", "victim_of"))
    marked = durable(faults.drivers(moving))
    leading = marked.where("driver")
    grouped = faults.driver_groups(leading.withColumn("reach", F.lit(block)), found, n, sensors)
    member = durable(grouped.select("run_id", "drivers", F.col("onset").alias("first"), F.explode("members").alias("sensor")))

    marks = p.fault_marks(moved.join(leading.select(*KEYS, "onset"), KEYS), n, max(block, n // 50)).select(*KEYS, "gain", (F.abs("rho") > GAIN_RHO).alias("follows"), "kind")
    loops = faults.control_loops(marked, moving, roles, found).select("run_id", F.col("actuator").alias("sensor"), "shifted")
    modelled = models.select(*KEYS).distinct().withColumn("modelled", F.lit(True))
    same = groups.select(*KEYS, F.col("label").alias("same"))
    rows = member.join(leading.select(*KEYS, "source", "max_deviation"), KEYS)
    for part in (marks, loops, modelled, same):
        rows = rows.join(part, KEYS, "left")
    rows = durable(rows)
    # a lone driver of a redundancy group is a sensor fault only if no other member of the group drives
    others = rows.where("same is not null").groupBy("run_id", "same").agg(F.count("*").alias("driving"))
    first = lambda c: F.max_by(c, "max_deviation")  # noqa: E731  of the driver that deviates most
    cases = rows.join(others, ["run_id", "same"], "left").groupBy("run_id", "drivers").agg(
        F.sort_array(F.collect_list("sensor")).alias("members"), F.min("first").alias("onset"), F.count("*").alias("n_drivers"), F.bool_and("source").alias("all_sources"), F.coalesce(first("modelled"), F.lit(False)).alias("modelled"),
        (F.coalesce(first("modelled"), F.lit(False)) & (F.coalesce(first("gain"), F.lit(False)) | F.coalesce(first("follows"), F.lit(False)))).alias("gain"), F.coalesce(first("driving") == 1, F.lit(False)).alias("redundant"),
        F.bool_or(F.col("shifted").isNotNull()).alias("in_loop"), F.coalesce(F.max("shifted"), F.lit(0)).alias("shifted"), first("kind").alias("kind"),
    )
    slack = max(10, n // 100)
    near = cases.select("run_id", "drivers", "onset").join(points, "run_id").where(F.abs(F.col("cut_t") - F.col("onset")) <= slack)
    shared = near.groupBy("run_id", "drivers").agg((F.count_distinct("sensor") / sensors).alias("shared_share"), F.expr("cast(percentile(cut_t, 0.5) as long)").alias("shared_at"))
    told = cases.join(shared, ["run_id", "drivers"], "left").withColumns({"shared_share": F.coalesce("shared_share", F.lit(0.0)), "shared_at": F.coalesce("shared_at", "onset"), "slack": F.lit(slack)})
    hit = member.join(marked.where("victim_of is not null").select("run_id", F.col("victim_of").alias("sensor"), F.col("sensor").alias("victim")), KEYS).groupBy("run_id", "drivers").agg(F.count_distinct("victim").alias("n_victims"))
    agreed = ~F.col("all_sources") & (F.col("n_drivers") == 1) & F.col("redundant") & (F.col("fault") == "sensor-drift")
    spans = grouped.select("run_id", F.col("drivers").alias("name"), F.greatest(F.lit(0), "onset").cast("long").alias("from"), F.col("until").cast("long").alias("to"))
    parts = p.component_statistics(x.select(*KEYS, "s"), model, spans).groupBy("run_id", F.col("name").alias("drivers")).agg(F.first(F.abs(F.col("spe") / F.col("spe_limit") - F.col("t2") / F.col("t2_limit"))).alias("apart"))
    out = faults.verdict(told).join(hit, ["run_id", "drivers"], "left").join(parts, ["run_id", "drivers"], "left")
    sure = F.when(agreed, 0.9).otherwise(F.coalesce(F.least(F.lit(1.0), "apart"), F.lit(0.5)))
    return out.select("run_id", F.col("members").alias("drivers"), "fault", "onset", F.coalesce("n_victims", F.lit(0)).alias("n_victims"), sure.alias("confidence"))
