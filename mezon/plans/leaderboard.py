"""The leaderboard report: figures are made by Spark, one row per system; only those reach the driver."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezon.operators import relational, stats
from mezon.plans.evaluation import BASELINE, SYSTEMS, TOP

DASH = "—"


@dataclass
class Inputs:
    """Tables of a report; all but ``scores`` may be None and are then named as not run.

    scores: system, id, score. gates: system and the gate columns with ``passed``. categories: id,
    category. judged: system, id, mqm, mqm_std. references: name -> (system, id, score). chrf: name ->
    (system, n, chrf_pp, spbleu, degenerate). chunks: system, n_chunks.
    """

    scores: DataFrame
    n_bench: int
    gates: DataFrame | None = None
    categories: DataFrame | None = None
    judged: DataFrame | None = None
    references: dict[str, DataFrame] | None = None
    chrf: dict[str, DataFrame] | None = None
    chunks: DataFrame | None = None


def _f(x: float | None, digits: int = 4) -> str:
    return DASH if x is None else f"{x:.{digits}f}"


def _rows(df: DataFrame) -> dict:
    return {r["system"]: r for r in df.collect()}


def board(x: Inputs, iterations: int = stats.ITERATIONS) -> DataFrame:
    """One row per system: means, interval, p against the baseline, wins, losses and ties."""
    s = x.scores.where(F.col("score").isNotNull())
    shared = relational.shared_ids(s)
    mean = s.groupBy("system").agg(F.count("*").alias("n"), F.avg("score").alias("qe"), (F.sum("score") / F.lit(max(x.n_bench, 1))).alias("zero"))
    pm = s.join(shared, "id", "left_semi").groupBy("system").agg(F.avg("score").alias("paired"), F.count("*").alias("n_shared"))
    diffs = relational.paired(s, BASELINE)
    wlt = diffs.groupBy("system").agg(
        F.count_if(F.col("diff") > 0.01).alias("w"), F.count_if(F.col("diff") < -0.01).alias("l"), F.count_if(F.abs("diff") <= 0.01).alias("t")
    )
    out = mean.join(pm, "system", "left").join(stats.bootstrap_ci(s, ["system"], "score", "id", iterations), "system", "left")
    return out.join(stats.paired_p(diffs, ["system"], iterations=iterations), "system", "left").join(wlt, "system", "left")


def rank(rows: dict, key: str) -> list[str]:
    """Registered systems by a figure, best first; ties in registry order."""
    return sorted((s for s in SYSTEMS if s in rows and rows[s][key] is not None), key=lambda s: (-rows[s][key], SYSTEMS.index(s)))


def render(x: Inputs, iterations: int = stats.ITERATIONS) -> str:
    """The report as Markdown."""
    b = _rows(board(x, iterations))
    key = "paired" if any(r["paired"] is not None for r in b.values()) else "qe"
    order = rank(b, key)
    leader = order[0] if order else None
    gate = {}
    if x.gates is not None:
        gate = _rows(x.gates.groupBy("system").agg(F.avg(F.col("passed").cast("double")).alias("pass_all"), F.avg("entity_keep").alias("entity_keep"), F.count_if("empty").alias("empty")))
    mq = _rows(x.judged.groupBy("system").agg(F.avg("mqm").alias("mqm"), F.avg("mqm_std").alias("std"), F.every(F.col("mqm_std") == 0).alias("zero"))) if x.judged is not None else {}
    shared = max((r["n_shared"] or 0 for r in b.values()), default=0)
    out = ["# Leaderboard", "", f"Ranked by the mean over the {shared} segments every system has a score for. Baseline `{BASELINE}`; leader `{leader or DASH}`.", ""]
    head = ["system", "n", "empty", "gates passed", "entities kept", "QE (paired)", "QE (all)", "95% CI", "p(base)", "W/L/T"] + (["MQM"] if mq else [])
    out += ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for s in order or [k for k in SYSTEMS if k in b]:
        r, g = b[s], gate.get(s)
        base = s == BASELINE
        p = "baseline" if base else DASH if r["p"] is None else f"{r['p']}{'*' if r['p'] < 0.05 else ''}"
        cells = [
            s, str(r["n"]), str(g["empty"]) if g else DASH, _f(g["pass_all"]) if g else DASH, _f(g["entity_keep"]) if g else DASH, _f(r["paired"]), _f(r["qe"]),
            DASH if r["ci_low"] is None else f"[{r['ci_low']}, {r['ci_high']}]", p, "baseline" if base else DASH if r["w"] is None else f"{r['w']}/{r['l']}/{r['t']}",
        ]
        out.append("| " + " | ".join(cells + ([_f(mq[s]["mqm"]) if s in mq else DASH] if mq else [])) + " |")
    out += _chunk_note(x) + _pairs(x, order, iterations) + _robustness(x, b, order, gate) + _categories(x, order) + _references(x) + _chrf(x) + _agreement(x, b, mq)
    missing = [n for n, v in (("structural gates", x.gates), ("judge", x.judged), ("reference scores", x.references), ("chrF++", x.chrf), ("categories", x.categories)) if not v and v is not x.gates or v is None]
    if missing:
        out += ["", "## Not run", "", *(f"- {m}" for m in missing)]
    out += ["", "## Caveats", "", "- A learned metric is not a human; read the intervals before the means.", "- Empty answers have no score; see the robustness note."]
    if mq:
        out.append("- The judge is itself a model and may favour its own family.")
    return "\n".join(out) + "\n"


def _chunk_note(x: Inputs) -> list[str]:
    if x.chunks is None:
        return []
    n, m = x.chunks.agg(F.count_if(F.coalesce("n_chunks", F.lit(1)) > 1), F.count("*")).first()
    return ["", f"Sources beyond the length limit were scored in chunks: {n} of {m} pairs." if n else "No pair was scored in chunks; long sources may be cut by the metric."]


def _pairs(x: Inputs, order: list[str], iterations: int) -> list[str]:
    top = order[:TOP]
    if len(top) < 2:
        return []
    ranks = x.scores.sparkSession.createDataFrame([(s, i) for i, s in enumerate(top, 1)], "system string, rank int")
    p = {(r["a"], r["b"]): r["p"] for r in stats.paired_p(relational.pairs_of(x.scores, ranks), ["a", "b"], iterations=iterations).collect()}
    out = ["", "## Top systems pairwise", "", "| row beats column | " + " | ".join(top) + " |", "|" + "---|" * (len(top) + 1)]
    for i, a in enumerate(top):
        cells = ["" if j <= i else DASH if p.get((a, c)) is None else f"{p[a, c]}{'*' if p[a, c] < 0.05 else ''}" for j, c in enumerate(top)]
        out.append(f"| {a} | " + " | ".join(cells) + " |")
    return out


def _robustness(x: Inputs, b: dict, order: list[str], gate: dict) -> list[str]:
    zero = rank(b, "zero")
    moved = [f"{s} {order.index(s) + 1} to {zero.index(s) + 1}" for s in order if s in zero and order.index(s) != zero.index(s)]
    out = ["", "## Empty answers", "", "Counting every missing score as 0 " + ("moves " + ", ".join(moved) + "." if moved else "moves no system.")]
    bad = [f"{s}: {b[s]['n']} scored + {gate[s]['empty']} empty, {x.n_bench} expected" for s in order if s in gate and b[s]["n"] + gate[s]["empty"] != x.n_bench]
    return out + ([""] + [f"- inconsistent inputs: {t}" for t in bad] if bad else [])


def _categories(x: Inputs, order: list[str]) -> list[str]:
    if x.categories is None:
        return []
    s = x.scores.join(x.categories, "id", "left").withColumn("category", F.coalesce("category", F.lit("all")))
    cells = {(r["system"], r["category"]): r["m"] for r in s.groupBy("system", "category").agg(F.avg("score").alias("m")).collect()}
    cats = sorted({c for _, c in cells})
    return ["", "## By category", "", "| system | " + " | ".join(cats) + " |", "|" + "---|" * (len(cats) + 1)] + [
        f"| {t} | " + " | ".join(_f(cells.get((t, c)), 3) for c in cats) + " |" for t in order
    ]


def _references(x: Inputs) -> list[str]:
    out = []
    for name, df in (x.references or {}).items():
        shared = relational.shared_ids(df).withColumn("s", F.lit(1))
        agg = df.join(shared, "id", "left").groupBy("system").agg(F.avg(F.when(F.col("s") == 1, F.col("score"))).alias("m"), F.count_if(F.col("s").isNull()).alias("x"))
        rows = sorted(agg.collect(), key=lambda r: (-(r["m"] if r["m"] is not None else -1e9), r["system"]))
        out += ["", f"## Reference scores: {name}", "", "| system | mean | excluded |", "|---|---|---|"] + [f"| {r['system']} | {_f(r['m'])} | {r['x']} |" for r in rows]
    return out


def _chrf(x: Inputs) -> list[str]:
    out = []
    for name, df in (x.chrf or {}).items():
        rows = df.orderBy(F.desc("chrf_pp"), "system").collect()
        out += ["", f"## chrF++: {name}", "", "| system | n | chrF++ | BLEU |", "|---|---|---|---|"] + [f"| {r['system']} | {r['n']} | {r['chrf_pp']} | {r['spbleu']} |" for r in rows]
        if loops := sum(r["degenerate"] or 0 for r in rows):
            out += ["", f"{loops} answers are runaway repetitions; each weighs on a corpus score."]
    return out


def _agreement(x: Inputs, b: dict, mq: dict) -> list[str]:
    figures = {"QE": {s: r["paired"] if r["paired"] is not None else r["qe"] for s, r in b.items()}}
    if x.chrf:
        both = [_rows(df) for df in x.chrf.values()]
        figures["chrF++"] = {s: sum(t[s]["chrf_pp"] for t in both if s in t) / sum(s in t for t in both) for t0 in both for s in t0}
    if mq:
        figures["MQM"] = {s: r["mqm"] for s, r in mq.items()}
    out, spark = [], x.scores.sparkSession
    for other in list(figures)[1:]:
        rows = [(s, float(v), float(figures[other][s])) for s, v in figures["QE"].items() if v is not None and figures[other].get(s) is not None]
        df = spark.createDataFrame(rows, "system string, a double, b double")
        r, rho = df.agg(stats.pearson(F.col("a"), F.col("b"))).first()[0], stats.spearman(df, "a", "b").first()[0]
        out.append(f"- QE and {other} over {len(rows)} systems: Pearson {_f(r)}, Spearman {_f(rho)}")
    if mq:
        seg = x.scores.join(x.judged, ["system", "id"]).where("score IS NOT NULL AND mqm IS NOT NULL")
        n, r = seg.agg(F.count("*"), stats.pearson(F.col("score"), F.col("mqm"))).first()
        out.append(f"- segments: Pearson {_f(r)} over {n}" if n >= 30 else f"- segments: {n} pairs, too few for a correlation")
        if all(m["zero"] for m in mq.values()):
            out.append("- every judge run of a segment agrees exactly: the runs are not independent, so their spread says nothing")
    return ["", "## Agreement of metrics", "", *out] if out else []


def render_html(x: Inputs, title: str = "Leaderboard", iterations: int = 200) -> str:
    """A board as a standalone HTML page."""
    b = _rows(board(x, iterations))
    body = []
    for i, s in enumerate(rank(b, "paired") or rank(b, "qe"), 1):
        r = b[s]
        beats = "baseline" if s == BASELINE else DASH if r["p"] is None else "beats the baseline" if r["p"] < 0.05 else "no significant difference"
        width = round(100 * max(0.0, min(1.0, r["paired"] if r["paired"] is not None else r["qe"])), 1)
        body.append(f"<tr><td>{i}</td><td>{html.escape(s)}</td><td>{_f(r['paired'])}</td><td><div style='width:{width}%'></div></td><td>{beats}</td></tr>")
    style = "body{font:15px sans-serif}td{padding:4px 10px}div{background:#47a;height:10px}"
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style><h1>{html.escape(title)}</h1><table>{''.join(body)}</table>\n"
