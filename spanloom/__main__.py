"""Command line: derive, ingest, probe, review, diff, gate, trend, doctor. Exit codes: 0 good, 1 regression or finding, 2 input that can't be used."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions.text import combined_fingerprint, hash_text, model_family
from .operators import cluster, compare, health, mining, probes, scoring, simulate
from .sources import endpoint, files, logs


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        for flags, kw in options:
            c.add_argument(*flags.split(), **kw)

    tools, drop = ("--tools", {"required": True}), ("--max-drop", {"type": float, "default": compare.MAX_DROP})
    sources = (("--traces", {}), ("--mined", {}), ("--json-mode", {"action": "store_true"}))
    form, sure = ("--format", {"choices": ["markdown", "json", "html", "table"], "default": "markdown"}), ("--confidence", {"type": float})
    add("derive", tools, *sources)
    add("ingest", ("logs", {"nargs": "+"}), ("--out", {"required": True}), ("--format", {"choices": logs.FORMATS, "default": "auto"}), ("--min-agreement", {"type": int, "default": 2}), ("--min-agreement-notool", {"type": int, "default": 3}), ("--per-capability", {"type": int, "default": 8}), ("--max-context-tokens", {"type": int, "default": 8192}), ("--redact-patterns", {"default": ""}), ("--cluster", {"choices": ["hash", "embeddings"], "default": "hash"}), ("--vectors", {}), ("--embed-endpoint", {}), ("--embed-model", {"default": ""}), ("--cluster-threshold", {"type": float, "default": 0.92}))
    add("probe", tools, *sources, ("--simulate", {}), ("--endpoint", {}), ("--model", {"default": ""}), ("--api-key", {"default": ""}), ("--samples", {"type": int, "default": 1}), ("--label", {"default": ""}), ("--out", {}), ("--allow-sensitive", {"action": "store_true"}))
    add("review", ("file", {}), ("--auto-accept", {"default": "schema_validity"}), ("--auto-accept-all", {"action": "store_true"}))
    add("diff", ("baseline", {}), ("candidate", {}), drop, sure, form)
    add("gate", ("-b --baseline", {"required": True}), ("-c --candidate", {"required": True}), drop, sure, ("--require-same-model", {"action": "store_true"}))
    add("trend", ("cards", {"nargs": "+"}), drop, form)
    add("doctor", tools, ("--mined", {}), ("--traces", {}), ("--strict", {"action": "store_true"}))
    return p


def _battery(spark: SparkSession, a: argparse.Namespace, allow_sensitive: bool = True) -> DataFrame:
    out = probes.derive(spark, files.load_tools(a.tools), a.json_mode)
    if a.traces:
        records = files.read_records(spark, a.traces)
        extra = probes.derive_traced(records).join(records.select(F.col("id").alias("record"), "messages", "tools"), "record").drop("record")
        out = out.unionByName(extra.withColumn("description", F.lit("from a recording")).withColumn("reference", F.lit("{}")), allowMissingColumns=True)
    if a.mined:
        out = out.unionByName(probes.from_mined(files.load_mined(spark, a.mined), allow_sensitive))
    return out


def _samples(spark: SparkSession, a: argparse.Namespace, battery: DataFrame, profile: dict, n: int) -> DataFrame:
    """(probe_id, capability, sample_no, score, error): simulated once, or asked n times."""
    if a.simulate:
        rates = spark.createDataFrame([(c, float(v)) for c, v in profile.get("capabilities", {}).items()], "capability string, rate double")
        scored = scoring.score(simulate.respond(simulate.passing(battery, rates))).withColumns({"error": F.lit(None).cast("string"), "sample_no": F.lit(0)})
    else:
        asked = battery.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("probe_id", F.col("id")).withColumn("id", F.concat_ws("#", "id", "sample_no"))
        asked = logs.landed(asked)
        got = logs.landed(endpoint.answers(asked, a.endpoint, a.model, a.api_key))
        scored = scoring.score(asked.join(got, "id")).withColumn("id", F.col("probe_id")).drop("probe_id")
    return scored.select(F.col("id").alias("probe_id"), "capability", "sample_no", "score", "error")


def _traces_mark(spark: SparkSession, a: argparse.Namespace) -> str | None:
    """One mark of all recorded checks that were run."""
    marks = []
    if a.traces:
        marks.append(probes.records_fingerprint(files.read_records(spark, a.traces)))
    if a.mined:
        marks.append(probes.mined_fingerprint(files.load_mined(spark, a.mined)))
    return spark.createDataFrame([(*marks, None, None)[:2]], "a string, b string").select(combined_fingerprint(F.col("a"), F.col("b"))).first()[0]


def _near(spark: SparkSession, a: argparse.Namespace, usable: DataFrame) -> DataFrame | None:
    """Clusters of near contexts, by vectors from a Parquet table (context_key, vec) or from an endpoint; none where that fails, so that equal contexts
    make the clusters."""
    if a.cluster == "hash":
        return None
    norm = F.transform("messages", lambda m: m["norm"])
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["norm_content"])), "\n")
    contexts = usable.select(mining.context_key(norm, F.col("tools")).alias("context_key"), text.alias("text")).groupBy("context_key").agg(F.min("text").alias("text"))
    try:
        vectors = spark.read.parquet(a.vectors) if a.vectors else endpoint.embeddings(contexts, a.embed_endpoint or "", a.embed_model)
        return logs.landed(cluster.near_clusters(contexts, logs.landed(vectors), a.cluster_threshold))
    except Exception as e:  # noqa: BLE001  whatever a foreign endpoint or table does, mining goes on
        print(f"no near clusters: {str(e).splitlines()[0][:200]}; equal contexts make the clusters", file=sys.stderr)
        return None


def _errored(cards: DataFrame) -> dict[str, dict[str, tuple[int, int]]]:
    each = cards.select("lock_id", F.explode("results").alias("r")).select("lock_id", "r.*")
    return {name: {r.capability: (r.errored, r.total) for r in scoring.error_negatives(each.where(F.col("lock_id") == k)).collect()} for k, name in ((0, "baseline"), (1, "candidate"))}


def _families(cards: DataFrame) -> list[str]:
    return [r[0] for r in cards.orderBy("lock_id").select(model_family(F.col("model"), F.col("quant"), F.col("runtime"))).collect()]


def _pair(spark: SparkSession, a: argparse.Namespace) -> tuple[list, list[str], tuple[str, str]]:
    cards = files.read_scorecards(spark, [a.baseline, a.candidate])
    each = files.scores(cards)
    rows = compare.diff(each.where("lock_id = 0"), each.where("lock_id = 1"), a.max_drop, a.confidence).collect()
    meta = [r.asDict() for r in cards.drop("results", "capabilities").orderBy("lock_id").collect()]
    families = tuple(_families(cards))
    return rows, compare.notes(meta[0], meta[1], families, _errored(cards)), families


def run(spark: SparkSession, argv: list[str]) -> int:
    a = _arguments().parse_args(argv)
    if getattr(a, "confidence", None) is not None and not 0 < a.confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    if a.command == "derive":
        for r in _battery(spark, a).orderBy("capability", "id").toLocalIterator():
            print(json.dumps({"id": r.id, "capability": r.capability, "description": r.description}))
    elif a.command == "ingest":
        config = mining.Config(a.min_agreement, a.min_agreement_notool, a.per_capability, a.max_context_tokens, tuple(x for x in a.redact_patterns.split(",") if x), a.cluster)
        everything = logs.landed(logs.read_logs(spark, a.logs, a.format))
        usable = logs.usable(everything)
        mined, summary = mining.mine(usable, config, _near(spark, a, usable))
        files.save_mined(mined, a.out)
        for r in logs.skip_counts(everything).collect():
            print(f"skipped {r.skip_reason}: {r['count']}")
        for r in summary.orderBy("counter", "name").collect():
            print(f"{r.counter} {r.name}: {r['count']}")
    elif a.command == "probe":
        if bool(a.simulate) == bool(a.endpoint):
            raise ValueError("either --simulate or --endpoint")
        profile = json.loads(open(a.simulate).read()) if a.simulate else {"model": a.model}
        battery = _battery(spark, a, a.allow_sensitive or not a.out)
        n = max(1, a.samples) if a.endpoint else 1
        results = scoring.pass_rates(_samples(spark, a, battery, profile, n)).cache()
        if results.isEmpty() or scoring.all_errored(results):
            raise ValueError("no check could be run")
        means = {r.capability: r.score for r in scoring.capability_scores(results).collect()}
        for c, v in means.items():
            print(f"{c}: {v:.4f}")
        if a.out:
            tools = spark.createDataFrame([(json.dumps(t, sort_keys=True),) for t in files.load_tools(a.tools)], "t string")
            mark = tools.agg(hash_text(F.array_join(F.array_sort(F.collect_list("t")), ","))).first()[0]
            rows = [r.asDict() for r in results.select("probe_id", "capability", "score", "error").orderBy("probe_id").collect()]
            card = files.scorecard({**{k: profile.get(k) for k in ("model", "quant", "runtime")}, "label": a.label or profile.get("label"), "capabilities": means, "results": rows, "samples": n, "tools_fingerprint": mark, "traces_fingerprint": _traces_mark(spark, a), "generated_at": datetime.now(UTC).isoformat()})
            files.write_scorecard(card, a.out)
    elif a.command == "review":
        mined = probes.auto_accept(files.load_mined(spark, a.file), tuple(a.auto_accept.split(",")), a.auto_accept_all).cache()
        counts = mined.groupBy("status").count().orderBy("status").collect()
        files.save_mined(mined, a.file)
        print(*(f"{r.status}: {r['count']}" for r in counts), sep="\n")
    elif a.command == "diff":
        rows, notes, _ = _pair(spark, a)
        print(report.render_diff(rows, a.format, notes, a.max_drop))
    elif a.command == "gate":
        rows, notes, families = _pair(spark, a)
        print(report.render_diff(rows, "markdown", notes, a.max_drop))
        if a.require_same_model and families[0] != families[1]:
            return 2
        return int(any(r.status in ("regression", "removed") for r in rows))
    elif a.command == "trend":
        if len(a.cards) < 2:
            raise ValueError("a ladder has two rungs at least")
        cards = files.read_scorecards(spark, a.cards)
        labels = [r.label or r.quant or str(r.lock_id) for r in cards.orderBy("lock_id").collect()]
        rungs = files.scores(cards).select("capability", F.col("lock_id").alias("pos"), "score")
        meta = [r.asDict() for r in cards.drop("results", "capabilities").orderBy("lock_id").collect()]
        print(report.render_trend(compare.trend(rungs, len(a.cards), a.max_drop).collect(), labels, a.format, compare.trend_notes(meta, _families(cards))))
    elif a.command == "doctor":
        tools = probes_frame(spark, json.loads(open(a.tools).read()))
        found = health.toolset_health(tools)
        if a.mined:
            found = found.unionByName(health.drift(tools.select("place", "name", "parameters"), health.frozen_tools(files.load_mined(spark, a.mined))))
        if a.traces:
            found = found.unionByName(health.drift(tools.select("place", "name", "parameters"), health.recorded_tools(files.read_records(spark, a.traces))))
        rows = found.collect()
        print(report.render_findings(rows))
        return int(any(r.level == "error" or a.strict for r in rows))
    return 0


def probes_frame(spark: SparkSession, tools: list) -> DataFrame:
    """Tool definitions as rows; names may come twice, which is for the doctor to say."""
    if not isinstance(tools, list) or not all(isinstance(t, dict) and isinstance(t.get("function"), dict) and t["function"].get("name") for t in tools):
        raise ValueError("a tools file is an array of functions with names")
    return spark.createDataFrame([(k, t["function"]["name"], t["function"].get("description", ""), json.dumps(t["function"].get("parameters") or {})) for k, t in enumerate(tools)], "place int, name string, description string, parameters string")


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    try:
        return run(spark, sys.argv[1:] if argv is None else argv)
    except (ValueError, OSError, KeyError) as e:
        print(f"spanloom: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
