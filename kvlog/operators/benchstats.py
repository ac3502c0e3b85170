"""Benchmark output: parsing, medians, validity gates and report tables."""

from __future__ import annotations

import json
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


class ParseError(ValueError):
    """Tool output that cannot be a result; the text says what is wrong."""


def to_number(text: Column) -> Column:
    """A double, or null where the text is not one: stricter than a cast, which takes suffixes."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def parse_throughput(lines: DataFrame) -> DataFrame:
    """(file, command, rps, p50, p99, error) of the rows of `lines` (file, n, line): the CSV of a load
    generator, with or without a header. Columns go by name, else by place; a percentile that
    cannot be read is 0. A file with one bad row, or none, is one row with the error."""

    def fields(line):
        return [x.strip().strip('"') for x in line.split(",")]

    def number(text):
        try:
            return float(text)
        except ValueError:
            return None

    def parse(rows):
        rows = [fields(x) for x in rows if x.strip()]
        if rows and len(rows[0]) > 1 and number(rows[0][1]) is None:
            head, rows = [h.lower() for h in rows[0]], rows[1:]
        else:
            head = []
        at = {"p50": -1, "p99": -1, "rps": 1}
        for i, h in enumerate(head):
            if "rps" in h:
                at["rps"] = i
            elif "p50" in h:
                at["p50"] = i
            elif "p99" in h and "p99.9" not in h:
                at["p99"] = i
        out = []
        for r in rows:
            if len(r) <= at["rps"]:
                raise ParseError("too few columns")
            rps = number(r[at["rps"]])
            if rps is None or not math.isfinite(rps) or rps < 0:
                raise ParseError("bad rate")
            optional = lambda k: (number(r[at[k]]) or 0.0) if 0 <= at[k] < len(r) else 0.0  # noqa: E731, B023
            out.append((r[0], rps, optional("p50"), optional("p99")))
        if not out:
            raise ParseError("no results")
        return out

    schema = "file string, command string, rps double, p50 double, p99 double, error string"

    def run(key, pdf):
        pdf = pdf.sort_values("n")
        try:
            rows = [(key[0], *r, None) for r in parse(pdf["line"].fillna("").tolist())]
        except ParseError as bad:
            rows = [(key[0], None, None, None, None, str(bad))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return lines.select("file", "n", "line").groupBy("file").applyInPandas(run, schema)


def parse_hit_ratio(files: DataFrame) -> DataFrame:
    """(file, hit_ratio, ops, p50, p99, p999, error) of `files` (file, content), JSON of a load
    generator; negative rates or none at all are an error."""

    def one(name, content):
        try:
            totals = json.loads(content or "")["ALL STATS"]["Totals"]
            hits, misses = float(totals["Hits/sec"]), float(totals["Misses/sec"])
            late = totals.get("Percentile Latencies", {})
            if not (hits >= 0 and misses >= 0 and hits + misses > 0):
                raise ParseError("no reads")
            return (name, hits / (hits + misses), float(totals.get("Ops/sec", 0)), *(float(late.get(k, 0)) for k in ("p50.00", "p99.00", "p99.90")), None)
        except (ValueError, KeyError, TypeError) as bad:
            return (name, None, None, None, None, None, str(bad) if isinstance(bad, ParseError) else "malformed")

    names = ["file", "hit_ratio", "ops", "p50", "p99", "p999", "error"]

    def run(batches):
        for batch in batches:
            rows = [one(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            kinds = [pa.string(), *[pa.float64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)

    return files.select("file", "content").mapInArrow(run, "file string, hit_ratio double, ops double, p50 double, p99 double, p999 double, error string")


def median_hit_run(runs: DataFrame) -> DataFrame:
    """(experiment, run_id): of `runs` (experiment, run_id, hits, misses) the run whose hit ratio is
    nearest the median of its experiment, of equals the earliest. A run without reads has ratio 0."""
    reads = F.col("hits") + F.col("misses")
    rated = runs.select("experiment", "run_id", F.when(reads > 0, F.col("hits").cast("double") / reads).otherwise(F.lit(0.0)).alias("ratio"))
    mid = rated.groupBy("experiment").agg(F.median("ratio").alias("mid"))
    return rated.join(mid, "experiment").groupBy("experiment").agg(F.min_by("run_id", F.struct(F.abs(F.col("ratio") - F.col("mid")), F.col("run_id"))).alias("run_id"))


#: What names one configuration of the rig; its rows are the repeats.
CONFIGURATION = ("experiment", "subject", "cores", "data_size", "rate")


def gated(runs: DataFrame, line_mbps: int = 25000, least_cpu: int = 65) -> DataFrame:
    """Of each configuration of `runs` (CONFIGURATION, run_id, ops, failed, srv_cpu, cli_cpu, srv_nic,
    cli_nic, srv_mbps, cli_mbps and more) the run nearest its median rate, of equals the first,
    with cov, the spread of the repeats, and what its validity is: one failed or idle repeat
    fails it; then come a busy client, a busy network on either side by its own measure or by
    eight tenths of the line rate, a server that unlimited load leaves idle, and the spread."""
    mid = runs.groupBy(*CONFIGURATION).agg(F.median("ops").alias("_mid"), F.coalesce(F.stddev_pop("ops") / F.nullif(F.avg("ops"), F.lit(0.0)), F.lit(0.0)).alias("cov"), F.bool_or(F.col("failed") | (F.col("ops") == 0)).alias("_broken"))
    near = runs.join(mid, list(CONFIGURATION)).withColumn("_apart", F.abs(F.col("ops") - F.col("_mid")))
    one = near.groupBy(*CONFIGURATION).agg(F.min_by(F.struct(*[c for c in near.columns if c not in CONFIGURATION]), F.struct("_apart", "run_id")).alias("r")).select(*CONFIGURATION, "r.*")
    hot = lambda side: (F.col(f"{side}_nic") >= 80) | (F.col(f"{side}_mbps") >= 0.8 * line_mbps)
    valid = (
        F.when(F.col("_broken"), "memtier-failed")
        .when(F.col("cli_cpu") >= 85, "rig-limited:client-cpu")
        .when(hot("srv") | hot("cli"), "rig-limited:nic")
        .when((F.col("rate") == 0) & (F.col("srv_cpu") < least_cpu), f"under-generated:srv-cpu<{least_cpu}")
        .when(F.col("cov") > 0.05, "noisy:cov>5%")
        .otherwise("valid")
    )
    return one.withColumn("valid", valid).drop("_mid", "_broken", "_apart")


def cpu_list(text: Column) -> Column:
    """The numbers of a list such as 0,2,4-7, each once, ascending."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.split(p, "-"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(F.element_at(e, 1).cast("int"), F.element_at(e, -1).cast("int"))))))


def sections(lines: DataFrame) -> DataFrame:
    """`lines` (file, n, line) with `section`, the name of the @@NAME@@ line last above them; lines
    above the first such line, and these lines themselves, are left out."""
    name = F.regexp_extract("line", "^@@(MPSTAT|SAR|SI1|SI2)@@$", 1)
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_name", F.when(name != "", name)).withColumn("section", F.last("_name", ignorenulls=True).over(order))
    return marked.filter("section is not null and _name is null").drop("_name")


def mpstat(lines: DataFrame) -> DataFrame:
    """(file, core, busy) of the rows of `lines` (file, n, line) that give averages: 100 less the idle
    share; the row of all cores is core -1."""
    cols = F.split(F.trim("line"), r"\s+")
    rows = lines.filter(F.trim("line").startswith("Average:")).select("file", F.get(cols, F.lit(1)).alias("core"), to_number(F.element_at(cols, -1)).alias("idle"))
    core = F.when(F.col("core") == "all", F.lit(-1)).when(F.col("core").rlike(r"^\d+$"), F.col("core").cast("long"))
    return rows.select("file", core.cast("long").alias("core"), (100 - F.col("idle")).alias("busy")).filter("core is not null and busy is not null")


def sar(lines: DataFrame) -> DataFrame:
    """(file, iface, rx_mbps, tx_mbps, util) of the busiest interface that is not the loopback, of equals
    the first, from the averages of `lines` (file, n, line); columns go by the names of the header."""
    split = lines.select("file", "n", F.split(F.trim("line"), r"\s+").alias("c"))
    head = split.filter(F.array_contains("c", "IFACE") & F.array_contains("c", "rxkB/s")).groupBy("file").agg(F.max_by("c", "n").alias("head"))
    value = lambda name: to_number(F.get("c", (F.array_position("head", name) - 1).cast("int")))
    at = lambda name: F.array_position("head", name)
    rows = split.filter((F.get("c", F.lit(0)) == "Average:") & ~F.array_contains("c", "IFACE")).join(head, "file")
    found = rows.select("file", "n", F.get("c", (at("IFACE") - 1).cast("int")).alias("iface"), (value("rxkB/s") * 8 / 1000).alias("rx_mbps"), (value("txkB/s") * 8 / 1000).alias("tx_mbps"), F.when(at("%ifutil") > 0, value("%ifutil")).otherwise(F.lit(0.0)).alias("util"))
    found = found.filter("iface <> 'lo' and rx_mbps is not null and tx_mbps is not null and util is not null")
    best = F.max_by(F.struct("iface", "rx_mbps", "tx_mbps", "util"), F.struct(F.col("rx_mbps") + F.col("tx_mbps"), -F.col("n")))
    return found.groupBy("file").agg(best.alias("b")).select("file", "b.*")


def softirq(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, delta): what the receive and transmit counters of all cores have gained between two sets
    of lines (file, line)."""

    def total(lines, sign):
        cols = F.split(F.trim("line"), r"\s+")
        return lines.filter(F.trim("line").rlike("^NET_(RX|TX)")).select("file", F.explode(F.slice(cols, 2, F.size(cols) - 1)).alias("x")).filter(F.col("x").rlike("^[0-9]+$")).select("file", (F.col("x").cast("long") * sign).alias("x"))

    return total(after, 1).unionByName(total(before, -1)).groupBy("file").agg(F.sum("x").alias("delta"))


def host_stats(lines: DataFrame, pinned: str) -> DataFrame:
    """(file, cpu_avg, cpu_max, cpu_pinned, nic_rx_mbps, nic_tx_mbps, nic_util, softirq_net) of the
    sections of each file of `lines` (file, n, line), to one decimal; cpu_pinned is the mean over
    the cores of the list that are there, or of all if none is. What is missing is 0."""
    parts = sections(lines)
    of = lambda name: parts.filter(F.col("section") == name)
    own = F.when(F.array_contains(cpu_list(F.lit(pinned)), F.col("core").cast("int")), F.col("busy"))
    cpu = mpstat(of("MPSTAT")).groupBy("file").agg(F.max(F.when(F.col("core") < 0, F.col("busy"))).alias("a"), F.max(F.when(F.col("core") >= 0, F.col("busy"))).alias("m"), F.avg(own).alias("p"))
    rows = lines.select("file").distinct().join(cpu, "file", "left").join(sar(of("SAR")), "file", "left").join(softirq(of("SI1"), of("SI2")), "file", "left")
    tenth = lambda *c: F.round(F.coalesce(*map(F.col, c), F.lit(0.0)), 1)
    return rows.select("file", tenth("a").alias("cpu_avg"), tenth("m").alias("cpu_max"), tenth("p", "a").alias("cpu_pinned"), tenth("rx_mbps").alias("nic_rx_mbps"), tenth("tx_mbps").alias("nic_tx_mbps"), tenth("util").alias("nic_util"), F.coalesce("delta", F.lit(0)).alias("softirq_net"))


def parse_load(files: DataFrame) -> DataFrame:
    """(file, ops, p50, p99, p999, p9999, hit_ratio, error) of `files` (file, content), JSON of the rig's
    load generator. Hits and misses are those of the totals, else those of the reads; without
    either there is no hit ratio. A file that cannot be read, or has no p99.90, is the placeholder
    of a run without operations, and the error."""
    late = "struct<`p50.00`:double,`p99.00`:double,`p99.90`:double,`p99.99`:double>"
    kind = f"struct<`ALL STATS`:struct<Totals:struct<`Ops/sec`:double,`Hits/sec`:double,`Misses/sec`:double,`Percentile Latencies`:{late}>,Gets:struct<`Hits/sec`:double,`Misses/sec`:double>>>"
    stats = F.from_json("content", kind)["ALL STATS"]
    rows = files.select("file", stats["Totals"].alias("t"), stats["Gets"].alias("g"))
    field = lambda of, name: F.col(of)[name]
    whole = field("t", "Hits/sec").isNotNull()
    hits, misses = (F.when(whole, field("t", f"{k}/sec")).otherwise(field("g", f"{k}/sec")) for k in ("Hits", "Misses"))
    pct = F.col("t")["Percentile Latencies"]
    wrong = F.when(F.col("t").isNull(), "malformed").when(pct["p99.90"].isNull(), "no p99.90")
    good = lambda c: F.when(wrong.isNull(), c)
    spelled = [good(pct[f"p{k}"]).alias(n) for k, n in (("50.00", "p50"), ("99.00", "p99"), ("99.90", "p999"), ("99.99", "p9999"))]
    return rows.select("file", F.coalesce(good(F.bround(field("t", "Ops/sec"), 0)).cast("long"), F.lit(0)).alias("ops"), *spelled, good(F.when(hits + misses > 0, F.round(hits / (hits + misses), 4))).alias("hit_ratio"), wrong.alias("error"))


def clamped(specs: DataFrame, cores: int, counts: list[str]) -> DataFrame:
    """`specs` (cores and more) with cores and the named counts no more than a server has, and `pinned`,
    the list of the cores that are used."""
    fit = {c: F.least(F.col(c), F.lit(cores)) for c in ("cores", *counts)}
    return specs.withColumns({**fit, "pinned": F.concat(F.lit("0-"), (fit["cores"] - 1).cast("string"))})


def render_table(results: DataFrame, skipped: DataFrame, order: list[str]) -> DataFrame:
    """(rendered): one row, a table of seven columns of `results` (subject, get_rps, set_rps, hit_ratio,
    p50, p99, p999), subjects in the given order and others after them by name, with a footnote of
    the subjects that were `skipped`, if any. A rate, ratio or latency that is null, and a
    latency that is not above zero, is a dash."""
    dash = F.lit("\u2014")
    fixed = lambda x, n: F.bround(F.col(x).cast("decimal(38,12)"), n).cast(f"decimal(38,{n})").cast("string")
    late = lambda x: F.when(F.col(x) > 0, fixed(x, 3)).otherwise(dash)
    cells = ["subject", *[F.coalesce(fixed(c, n), dash) for c, n in (("get_rps", 0), ("set_rps", 0), ("hit_ratio", 4))], late("p50"), late("p99"), late("p999")]
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("subject")), F.lit(0)), F.lit(len(order) + 1))
    lines = results.select(F.struct(place, "subject", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n")).alias("line")).alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "").alias("body"))
    notes = skipped.agg(F.array_join(F.array_sort(F.collect_list("subject")), ", ").alias("names"))
    head = "| Server | GET rps | SET rps | Hit ratio | GET p50 ms | GET p99 ms | p99.9 ms |\n| --- | ---: | ---: | ---: | ---: | ---: | ---: |\n"
    note = F.when(F.col("names") != "", F.concat(F.lit("\n_Skipped (tooling unavailable): "), "names", F.lit("._\n"))).otherwise("")
    return lines.crossJoin(notes).select(F.concat(F.lit(head), "body", note).alias("rendered"))


def human_bytes(n: Column) -> Column:
    """Whole gigabytes as such, else whole megabytes, as tools take them."""
    unit = F.when(n % (1 << 30) == 0, F.struct(F.lit(30).alias("bits"), F.lit("gb").alias("name"))).otherwise(F.struct(F.lit(20).alias("bits"), F.lit("m").alias("name")))
    return F.concat(F.floor(n / F.pow(F.lit(2.0), unit["bits"])).cast("string"), unit["name"])


def markdown(df: DataFrame, columns: list[tuple[str, str]], order: list[Column]) -> DataFrame:
    """One row, one column `rendered`: the rows as a table of (column, title), in the given order, "-" for
    nulls. Reports are small: a row for each configuration."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = df.select(F.struct(*order).alias("_o"), line([F.coalesce(F.col(c).cast("string"), F.lit("-")) for c, _ in columns]).alias("_line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_line"))), lambda x: x["_line"])
    head = "| " + " | ".join(t for _, t in columns) + " |", "|" + "|".join("---" for _ in columns) + "|"
    return rows.agg(F.array_join(F.concat(F.array(*map(F.lit, head)), lines), "\n").alias("rendered"))


def fixed(text: Column, places: int) -> Column:
    """A number to so many places; "-" where the text is none."""
    return F.coalesce(F.bround(to_number(text).cast("decimal(38,12)"), places).cast(f"decimal(38,{places})").cast("string"), F.lit("-"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of a CSV file with a header, all text as written."""
    return spark.read.csv(path, header=True, inferSchema=False)


def write_results(df: DataFrame, path: str, fields: list[str]) -> None:
    """The named fields only, in their order, those that are missing empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]).write.csv(path, header=True)
