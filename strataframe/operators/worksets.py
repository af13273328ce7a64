"""Sessions as relations of whole entries: nested records of each stage, their JSON, going back, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The records of an entry, as a saved session names them.
CLASSIFICATION = "struct<figure_type:string,confidence:double,reason:string,user_override:string>"
PANEL = "struct<id:int,bbox:array<int>,source:string,confidence:double>"
PANELS = f"struct<detected:array<{PANEL}>,target_panel_id:int,user_override:int>"
ATTEMPT = "struct<engine:string,n_layers:int,quality_score:double,notes:string,timestamp:string>"
SEGMENTATION = f"struct<result_dir:string,engine:string,n_layers:int,quality_score:double,overlay_path:string,labels_path:string,attempts:array<{ATTEMPT}>,user_feedback:array<string>>"
EXPORT = "struct<tomo_xyz:string,parfile_snippet:string>"
RECORDS = {"classification": CLASSIFICATION, "panels": PANELS, "segmentation": SEGMENTATION, "export": EXPORT}
FIELDS = {"figure_id": "string", "source_path": "string", "status": "string", **RECORDS, "skip_reason": "string", "error_message": "string"}
#: What each stage takes away, the record that going back to it needs, and the state that it leaves.
STAGES = {
    "classify": (("classification", "panels", "segmentation", "export"), None, "pending"),
    "panel": (("panels", "segmentation", "export"), "classification", "classified"),
    "segment": (("segmentation", "export"), "panels", "classified"),
}


def create(sources: DataFrame) -> DataFrame:
    """Entries of new sessions (session_id, source_path, ord): pending, named by their file without its ending."""
    stem = F.regexp_replace(F.regexp_extract("source_path", r"([^/]+?)(\.[^./]*)?$", 1), r"[^\p{IsAlphabetic}\p{IsDigit}_-]", "_")
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in FIELDS.items() if name not in ("figure_id", "source_path", "status")]
    return sources.select("session_id", "ord", stem.alias("figure_id"), "source_path", F.lit("pending").alias("status"), *empty)


def clamped(entries: DataFrame) -> DataFrame:
    """Confidences and scores between 0 and 1, whoever wrote them."""
    held = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    c, s = F.col("classification"), F.col("segmentation")
    # A field of a null record would make a record of nulls.
    put = lambda record, field: F.when(record.isNotNull(), record.withField(field, held(record[field])))
    return entries.withColumns({"classification": put(c, "confidence"), "segmentation": put(s, "quality_score")})


def update(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with the fields that a change (session_id, figure_id, some of FIELDS) has; what it lacks, or has as null, stays."""
    names = [n for n in FIELDS if n in changes.columns and n != "figure_id"]
    c = changes.select("session_id", "figure_id", *[F.col(n).alias(f"new_{n}") for n in names])
    out = entries.join(c, ["session_id", "figure_id"], "left")
    return out.select(*[F.coalesce(f"new_{n}", n).alias(n) if n in names else F.col(n) for n in entries.columns])


def backtrack(entries: DataFrame, stage: str) -> DataFrame:
    """Entries gone back to a stage, with ``refused`` where one lacks the record that the stage needs and stays as it is.

    A skipped or failed figure goes back too, if it has the record.
    """
    drops, needs, status = STAGES[stage]
    able = F.col(needs).isNotNull() if needs else F.lit(True)
    changed = {n: F.when(able, F.lit(None).cast(RECORDS[n])).otherwise(F.col(n)) for n in drops}
    return entries.withColumns({"refused": ~able, "status": F.when(able, status).otherwise(F.col("status")), **changed})


def to_json(entries: DataFrame) -> DataFrame:
    """(session_id, json): each session as one document, its figures in the order of the work set; nulls are written out."""
    row = F.struct("ord", *FIELDS)
    g = entries.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "figure_id", row.alias("e")))).alias("all"))
    work = F.transform("all", lambda q: q.e.dropFields("ord"))
    return g.select("session_id", F.to_json(F.struct(F.col("session_id").cast("string").alias("session_id"), work.alias("workset")), {"ignoreNullFields": "false"}).alias("json"))


def from_json(saved: DataFrame) -> DataFrame:
    """The entries of saved sessions (session_id, json); a document that can't be read fails, as half a session isn't one."""
    kind = "workset array<struct<" + ",".join(f"{n}:{k}" for n, k in FIELDS.items()) + ">>"
    s = saved.select("session_id", F.from_json("json", kind, {"mode": "FAILFAST"}).alias("s"))
    return s.select("session_id", F.posexplode("s.workset").alias("ord", "e")).select("session_id", F.col("ord").cast("long").alias("ord"), "e.*")


def feedback(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """Entries whose segmentation has taken in the messages (session_id, figure_id, at, text), oldest first; others wait for one."""
    m = messages.groupBy("session_id", "figure_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("said"))
    out = entries.join(m, ["session_id", "figure_id"], "left")
    texts = F.concat(F.coalesce(F.col("segmentation.user_feedback"), F.expr("cast(array() as array<string>)")), F.transform("said", lambda q: q.text))
    put = F.when(F.col("said").isNotNull() & F.col("segmentation").isNotNull(), F.col("segmentation").withField("user_feedback", texts)).otherwise(F.col("segmentation"))
    return out.withColumn("segmentation", put).select(entries.columns)


# ---- report


def _text(c: Column) -> Column:
    """Text that may hold signs of markup, for a page."""
    out = c
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.regexp_replace(out, sign, name)
    return out


STYLE = (
    "body{font:14px sans-serif;margin:2em;background:#f6f7f9}.cards{display:grid;grid-template-columns:repeat(auto-fill,minmax(220px,1fr));gap:1em}"
    ".card,.detail{background:#fff;border-radius:8px;padding:1em}.good{color:#15803d}.warn{color:#b45309}.bad{color:#b91c1c}.alert{color:#b91c1c;font-weight:bold}"
    "img{max-width:100%}.detail{margin-top:1em}dt{float:left;width:9em;color:#666}.stats span{margin-right:2em}"
)


def cards(entries: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(session_id, ord, figure_id, card, detail): a figure's card and its detail as HTML.

    ``images`` (figure_id, original, overlay) has addresses of pictures, such as ``overlays.pictures`` makes.
    """
    e = entries if images is None else entries.join(images.select("figure_id", "original", "overlay"), "figure_id", "left")
    if images is None:
        e = e.withColumns({"original": F.lit(None).cast("string"), "overlay": F.lit(None).cast("string")})
    dash = lambda c: F.coalesce(c, F.lit("—"))
    score, layers = F.col("segmentation.quality_score"), F.col("segmentation.n_layers")
    band = F.when(score >= 0.75, "good").when(score >= 0.6, "warn").otherwise("bad")
    kind = dash(_text(F.coalesce("classification.user_override", "classification.figure_type")))
    number = lambda c: dash(F.format_string("%.2f", c))
    img = lambda c, alt: F.when(F.col(c).isNotNull(), F.concat(F.lit('<img src="'), _text(F.col(c)), F.lit(f'" alt="{alt}">'))).otherwise(F.lit(f'<span class="none">no {alt}</span>'))
    alert = F.when((score < 0.7) & (F.col("status") == "segmented"), '<p class="alert">needs a review</p>').otherwise("")
    why = F.when(F.col("status") == "skipped", F.concat(F.lit("<p>skipped: "), dash(_text(F.col("skip_reason"))), F.lit("</p>"))).when(F.col("status") == "error", F.concat(F.lit("<p>error: "), dash(_text(F.col("error_message"))), F.lit("</p>"))).otherwise("")
    fig = _text(F.col("figure_id"))
    anchor = F.concat(F.lit("f"), F.col("ord").cast("string"))
    card = F.concat(
        F.lit('<div class="card"><a href="#'), anchor, F.lit('">'), img("overlay", "overlay"), F.lit("</a><h3>"), fig, F.lit("</h3><p>"), kind, F.lit(" · "), _text(F.col("status")),
        F.lit('</p><p class="'), band, F.lit('">'), number(score), F.lit("</p>"), alert, why, F.lit("</div>"),
    )
    item = lambda name, value: F.concat(F.lit(f"<dt>{name}</dt><dd>"), value, F.lit("</dd>"))
    files = F.array_join(F.transform(F.array_compact(F.array("export.tomo_xyz", "export.parfile_snippet")), lambda f: F.concat(F.lit("<li>"), _text(F.regexp_extract(f, "([^/]*)$", 1)), F.lit("</li>"))), "")
    detail = F.concat(
        F.lit('<div class="detail" id="'), anchor, F.lit('"><h2>'), fig, F.lit("</h2>"), img("original", "original"), img("overlay", "overlay"), F.lit("<dl>"),
        item("kind", kind), item("confidence", number(F.col("classification.confidence"))), item("score", number(score)), item("engine", dash(_text(F.col("segmentation.engine")))),
        item("layers", dash(layers.cast("string"))), item("target panel", F.concat(F.lit("#"), F.coalesce("panels.user_override", "panels.target_panel_id", F.lit(0)).cast("string"))),
        F.lit("</dl>"), F.when(files != "", F.concat(F.lit("<ul>"), files, F.lit("</ul>"))).otherwise(""), F.lit("</div>"),
    )
    return e.select("session_id", "ord", "figure_id", card.alias("card"), detail.alias("detail"))


def report(entries: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(session_id, html): one page a session: counts by state, the mean score, a card and a detail for each figure."""
    n = lambda s: F.count_if(F.col("status") == s)
    stats = entries.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), *[n(s).alias(s) for s in ("exported", "segmented", "skipped", "error")], F.avg("segmentation.quality_score").alias("mean"))
    body = cards(entries, images).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "figure_id", "card", "detail"))).alias("all"))
    line = F.concat(F.lit('<p class="stats">'), *[F.concat(F.lit(f"<span>{s} "), F.col(s).cast("string"), F.lit("</span>")) for s in ("total", "exported", "segmented", "skipped", "error")], F.lit("<span>mean score "), F.coalesce(F.format_string("%.2f", "mean"), F.lit("—")), F.lit("</span></p>"))
    page = F.concat(
        F.lit(f'<!doctype html><html><head><meta charset="utf-8"><title>Figures</title><style>{STYLE}</style></head><body><h1>Session '), _text(F.col("session_id").cast("string")), F.lit("</h1>"), line,
        F.lit('<div class="cards">'), F.array_join(F.transform("all", lambda q: q.card), ""), F.lit("</div>"), F.array_join(F.transform("all", lambda q: q.detail), ""), F.lit("</body></html>"),
    )
    return body.join(stats, "session_id").select("session_id", page.alias("html"))


def write_reports(pages: DataFrame, path: str) -> None:
    """A folder per session with its page as text."""
    pages.select("session_id", F.col("html").alias("value")).repartition("session_id").write.mode("overwrite").partitionBy("session_id").text(path)


# ---- tables as JSON


def properties_json(props: DataFrame) -> DataFrame:
    """(figure_id, json): a figure's property table by layer name: {"red": {"Vp": …, "Vs": …, "rho": …}, …}."""
    value = F.struct(F.col("vp").alias("Vp"), F.col("vs").alias("Vs"), F.col("rho").alias("rho"))
    g = props.groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct("name", value.alias("p")))).alias("all"))
    return g.select("figure_id", F.to_json(F.map_from_entries("all")).alias("json"))


def properties_of(saved: DataFrame) -> DataFrame:
    """(figure_id, name, vp, vs, rho, missing) of property tables (figure_id, json); ``missing`` names the values that an entry lacks."""
    m = saved.select("figure_id", F.explode(F.from_json("json", "map<string,struct<Vp:double,Vs:double,rho:double>>", {"mode": "FAILFAST"})).alias("name", "p"))
    lacks = F.array_compact(F.array(*[F.when(F.col(f"p.{k}").isNull(), F.lit(k)) for k in ("Vp", "Vs", "rho")]))
    return m.select("figure_id", "name", F.col("p.Vp").alias("vp"), F.col("p.Vs").alias("vs"), F.col("p.rho").alias("rho"), lacks.alias("missing"))


def templates_json(patterns: DataFrame, rates: DataFrame) -> DataFrame:
    """One row (json): what the attempt log has taught, as agents read it before a run: patterns, success rates, a summary."""
    best = F.array_sort(F.collect_list(F.struct("sat_bin", "edge_bin", "best_engine", "n", "success_rate", "avg_alignment", "confidence")))
    p = patterns.agg(best.alias("patterns"), F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"))
    r = rates.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "success_rate")))).alias("engine_success_rates"))
    # Two tables of one row each.
    both = p.withColumn("one", F.lit(1)).join(r.withColumn("one", F.lit(1)), "one")
    return both.select(F.to_json(F.struct("patterns", "engine_success_rates", F.struct(F.size("patterns").alias("n_patterns"), F.col("attempts").alias("n_attempts")).alias("summary"))).alias("json"))


def templates_of(saved: DataFrame) -> DataFrame:
    """The patterns of a templates document; without one, none."""
    kind = "patterns array<struct<sat_bin:string,edge_bin:string,best_engine:string,n:long,success_rate:double,avg_alignment:double,confidence:double>>"
    return saved.select(F.inline(F.from_json("json", kind)["patterns"]))


def rank(entries: DataFrame) -> DataFrame:
    """Entries with their place in the work set, from 1."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "figure_id")))
