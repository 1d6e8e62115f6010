"""The tables of the domain, derived from the supplied star-schema tables.

No supplied table holds geometry, so parcels, fields and facilities are laid out on an
integer plane from their keys: whole numbers make every area exact in any engine. The
plane is 1,000 wide and grows downwards with the data, so density does not change with
scale. The plane is positive in x and negative in y, so swapped axes are recognisable.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.plans.spread import spread
from landledger.policy import CATCHMENT, ERAS, INTAKE, MEMBERSHIP, MILL, SLAUGHTER, Policy

# On the plane one unit is one kilometre, and neighbours are not bridged.
PLANE = replace(
    Policy(),
    neighbor_gap_tolerance_m=0.0,
    study_box=(0.0, -1e9, 1e9, 0.0),
    cell=16.0,
    intake_km=30.0,
    intake_km_ceiling=90.0,
)

# The classes fields cycle through; 99 has no policy.
CLASSES = [15, 39, 35, 46, 21, 9, 18, 20, 40, 41, 47, 48, 62, 99]
TIERS = [MEMBERSHIP, INTAKE, SLAUGHTER, MILL, CATCHMENT]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n)


def parcel_id(k: Column) -> Column:
    """One id in fifty is carried by two parcels."""
    n = F.when(k % 50 == 49, k - 1).otherwise(k)
    return F.concat(F.lit("S"), (n % 5).cast("string"), F.lit("-"), (n % 40).cast("string"), F.lit("-"), n.cast("string"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = 10 * (k % 100) + k % 3, -10 * _div(k, 100) - 20
    raw = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"))
    base = raw.select(
        k.alias("row_key"),
        parcel_id(k).alias("cod_imovel"),
        (F.col("p_size") / 8.0).alias("num_area"),
        F.when(k % 10 < 7, "AT").when(k % 10 == 7, "PE").when(k % 10 == 8, "CA").otherwise("SU").alias("ind_status"),
        F.lit("IRU").alias("ind_tipo"), F.col("p_type").alias("des_condic"),
        G.box(x, y, x + 8 + k % 7, y + 8 + k % 5).alias("geometry"),
    )
    n = F.split_part("cod_imovel", F.lit("-"), F.lit(2))
    named = base.withColumns(
        {"cod_estado": F.split_part("cod_imovel", F.lit("-"), F.lit(1)), "municipio": F.concat(F.lit("M"), n)}
    )
    return G.with_shape(named)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    x, y = (k * 37) % 1000, -_div(k, 75) - 20
    classes = F.array(*[F.lit(float(c)) for c in CLASSES])
    zero = F.lit(0)
    bands = [
        F.when(k % 4 != 0, 1000 * (price % 7)),
        1000 * (price % 5),
        F.when(k % 3 == 0, 1000 * (price % 9)).otherwise(zero),
        F.when(k % 5 == 0, 1000 * (price % 11)).otherwise(zero),
        F.when(k % 6 == 0, 1000 * (price % 13)).otherwise(zero),
    ]
    source = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    raw = source.select(
        k.alias("Id"),
        F.get(classes, (k % 14).cast("int")).alias("mbmode24"),
        F.when(k % 9 != 0, 2001 + k % 24).cast("double").alias("mode_year"),
        (1985 + k % 30).cast("double").alias("firstyear"),
        *[b.cast("double").alias(name) for b, (name, _) in zip(bands, ERAS)],
        G.box(x, y, x + 2 + k % 5, y + 2 + k % 4).alias("geometry"),
    )
    return G.with_shape(raw)


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    tiers = F.array(*[F.lit(t) for t in TIERS])
    tier = F.get(tiers, (k % 5).cast("int"))
    x, y = (k * 173) % 1000 + 0.5, -2.0 * k - 20
    place = F.when(tier == CATCHMENT, G.box(x, y, x + 60, y + 40)).otherwise(G.point(x, y))
    raw = table(spark, sf_dir, "supplier").select(
        F.when(tier == MEMBERSHIP, (k % 40).cast("string")).otherwise(F.concat(F.lit("E"), k.cast("string")))
        .alias("entity_id"),
        F.when(tier == MEMBERSHIP, "cooperative").when(tier == MILL, "mill").otherwise("buyer").alias("entity_kind"),
        tier.alias("tier"), F.col("s_acctbal").alias("weight"),
        F.when(tier == CATCHMENT, "modelled").otherwise("observed").alias("basis"),
        place.alias("geometry"),
    )
    return G.with_shape(raw).withColumns({"x_km": F.col("xmin"), "y_km": F.col("ymin")})


def dirty_list(spark: SparkSession, sf_dir: str, land: DataFrame) -> DataFrame:
    """One list row per customer, naming the parcel of the same key, with every kind of defect."""
    n = F.col("c_custkey")
    src = F.when((n % 17 == 0) & (n > 0), n - 1).otherwise(n)
    rows = table(spark, sf_dir, "customer").select(n.alias("row_id"), src.alias("src"))
    s = F.col("src")
    land = land.select(F.col("row_key").alias("src"), "cod_imovel", "geometry", "area")
    far, lost = s % 97 == 11, s % 41 == 9
    anonymous = far | lost | (s % 10).isin(3, 5)
    # each step is a column, so that no step is copied into the next one's expressions
    shaped = rows.join(land, "src", "left")
    shaped = shaped.withColumn("_center", F.struct(*[c.alias(n) for n, c in G.centroid(F.col("geometry"), F.col("area")).items()]))
    shaped = shaped.withColumn("_given", F.when(s % 10 == 5, G.point(F.col("_center.cx"), F.col("_center.cy"))).otherwise(F.col("geometry")))
    shaped = shaped.withColumn("_turned", F.when(s % 23 == 7, G.flip(F.col("_given"))).otherwise(F.col("_given")))
    # shapes that no reader takes: empty, of another kind, cut short; two different lines are not copies
    odd = F.when(s % 194 == 11, F.concat(F.lit("LINESTRING (1 1, "), s.cast("string"), F.lit(" 2)"))).when(s % 388 == 108, "POINT EMPTY").when(s % 388 == 302, "POINT (1)")
    wkt = F.when(far, F.coalesce(odd, F.lit("POINT (-5 -5)"))).when(lost, " ").when(anonymous, G.to_wkt(F.col("_turned")))
    # A customer without a parcel of its key stays on the list under an id no parcel has.
    name = F.coalesce("cod_imovel", F.concat(F.lit("S0-0-"), s.cast("string")))
    raw_id = F.when(anonymous, "").otherwise(F.concat(F.lit(" "), name, F.lit(" ")))
    return shaped.select("row_id", raw_id.alias("raw_id"), wkt.alias("raw_wkt"))


def _outline(shape: str, **sizes: Column) -> Column:
    """Text of an outline whose corners are sums of the named columns."""
    def corner(word: str) -> Column:
        x, y = word.split(",")
        place = [sum((sizes[t] if t in sizes else F.lit(int(t)) for t in part.split("+")), F.lit(0)).cast("string") for part in (x, y)]
        return F.concat_ws(" ", *place)

    kind, rings = shape.split(" ", 1)
    text = []
    for ring in rings.split(" / "):
        text.append(F.concat(F.lit("("), F.concat_ws(", ", *[corner(w) for w in ring.split()]), F.lit(")")))
    if kind == "MULTIPOLYGON":
        text = [F.concat(F.lit("("), t, F.lit(")")) for t in text]
    return F.concat(F.lit(f"{kind} ("), F.concat_ws(", ", *text), F.lit(")"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of other forms: right triangles, angles two units thick, and squares with a square hole."""
    k = F.col("p_partkey")
    sizes = {"x": 10 * (k % 100), "y": (-10 * _div(k, 100)).cast("bigint"), "s": 6 + k % 5, "i": 4 + k % 5}
    triangle = _outline("POLYGON x,y x+s,y x,y+s x,y", **sizes)
    angle = _outline("POLYGON x,y x+s,y x+s,y+2 x+2,y+2 x+2,y+s x,y+s x,y", **sizes)
    holed = _outline("POLYGON x,y x+s,y x+s,y+s x,y+s x,y / x+2,y+2 x+i,y+2 x+i,y+i x+2,y+i x+2,y+2", **sizes)
    wkt = F.when(k % 3 == 0, triangle).when(k % 3 == 1, angle).otherwise(holed)
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).withColumn("wkt", wkt)
    return G.with_shape(rows.select(k.alias("row_key"), parcel_id(k).alias("cod_imovel"), G.from_wkt(F.col("wkt")).alias("geometry")))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of other forms: squares, right triangles, thin angles, and two squares in one."""
    k = F.col("o_orderkey")
    sizes = {"x": (k * 37) % 1000, "y": (-_div(k, 75)).cast("bigint"), "s": 3 + k % 4}
    square = _outline("POLYGON x,y x+s,y x+s,y+s x,y+s x,y", **sizes)
    triangle = _outline("POLYGON x,y x+s,y x,y+s x,y", **sizes)
    angle = _outline("POLYGON x,y x+s,y x+s,y+1 x+1,y+1 x+1,y+s x,y+s x,y", **sizes)
    two = _outline("MULTIPOLYGON x,y x+1,y x+1,y+1 x,y+1 x,y / x+2,y x+s,y x+s,y+1 x+2,y+1 x+2,y", **sizes)
    wkt = F.when(k % 4 == 0, square).when(k % 4 == 1, triangle).when(k % 4 == 2, angle).otherwise(two)
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey")).withColumn("wkt", wkt)
    return G.with_shape(rows.select(k.alias("Id"), G.from_wkt(F.col("wkt")).alias("geometry")))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long upright parcels, one in ten units; the least size of a column of parts decides how wide each is."""
    n = F.col("n")
    rows = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 100).alias("n")).agg((5 + F.min("p_size") % 4).alias("w"))
    return G.with_shape(rows.select(n.alias("row_key"), F.concat(F.lit("B"), n.cast("string")).alias("cod_imovel"), G.box(10 * n, F.lit(-400), 10 * n + F.col("w"), F.lit(400)).alias("geometry")))


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields across the bands, far from their ends."""
    k = F.col("s_suppkey")
    x, y = (k * 41) % 1000, -20 - k % 150
    return G.with_shape(table(spark, sf_dir, "supplier").select(k.alias("Id"), G.box(x, y, x + 4 + k % 15, y + 2).alias("geometry")))


def artifacts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs flagging parcels (orders) with a contact and a loss; several rows per parcel and run."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 4).alias("run"),
        (F.col("l_extendedprice") * 100 + F.col("l_partkey") / 1e6).alias("arrival"),
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("cod_imovel"),
        F.when(F.col("l_discount") == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("loss"),
        F.concat(F.lit("C"), (F.col("l_suppkey") % 4).cast("string")).alias("contact"),
    )


# -- audit tables ----------------------------------------------------------------

# Question, stage and the questions it builds on.
QUESTIONS = [
    ("q01", 1, []), ("q02", 1, []), ("q03", 1, []), ("q04", 1, []),
    ("q05", 2, ["q03"]), ("q06", 2, ["q05"]), ("q07", 2, ["q05"]),
    ("q08", 3, ["q05"]), ("q09", 3, ["q05"]), ("q10", 3, ["q09"]), ("q11", 3, ["q09"]), ("q12", 3, ["q09"]),
    ("q13", 3, ["q09"]), ("q14", 3, ["q09"]),
    ("q15", 4, ["q09"]), ("q16", 4, ["q09"]), ("q17", 4, ["q16"]), ("q18", 4, ["q16"]), ("q19", 4, ["q16"]),
    ("q20", 4, ["q16"]), ("q21", 4, ["q09"]), ("q22", 4, ["q09"]), ("q23", 4, ["q16"]),
    ("q24", 5, ["q16", "q20"]), ("q25", 5, ["q16"]), ("q26", 5, ["q24"]), ("q27", 5, ["q20"]),
    ("q28", 5, ["q24"]), ("q29", 5, ["q24"]), ("q30", 6, ["q24", "q26", "q27", "q28"]), ("q31", 2, ["q05"]),
]


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid string, stage int, depends_on array<string>")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per supplier answering every question, the outcome decided by its line items."""
    qid = F.format_string("q%02d", (F.col("l_partkey") % 31 + 1).cast("int"))
    total = F.sum("l_quantity").cast("bigint") % 10
    outcome = (
        F.when(total < 7, "correct").when(total == 7, "near_miss").when(total == 8, "wrong").otherwise("missing")
    )
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), qid.alias("qid")).agg(
        outcome.alias("outcome")
    )


def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("run"),
        F.get(F.array(*[F.lit(m) for m in ("haiku", "sonnet", "opus")]), F.col("s_nationkey") % 3).alias("model"),
        F.when(k % 13 == 0, "produced_nothing").when(k % 13 == 1, "incomplete").when(k % 13 != 2, "done")
        .alias("status"),
        F.when(k % 4 == 1, "full").when(k % 4 == 2, "no-coops").when(k % 4 == 3, "no-matching").alias("arm"),
        F.when(k % 7 == 0, F.lit(None)).when(F.col("s_nationkey") % 2 == 0, "a1b2").otherwise("c3d4")
        .alias("spec_fingerprint"),
        F.lit("g1").alias("golden_fingerprint"),
        F.when(k % 11 == 5, "g2").when(k % 11 != 6, "g1").alias("graded_against"),
        F.lit("").alias("label"),
        F.col("s_acctbal").alias("duration_seconds"), (F.col("s_acctbal") / 4).alias("slow_tool_seconds"),
        (k % 3).alias("timed_out_tool_calls"), (F.col("s_acctbal") / 1000).alias("imputed_cost_usd"),
        (k % 200).alias("turns"),
    )


ROWS_PER_QUESTION = 20
PART_RUNS = 4


def golden_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty parts make one golden table of key, type and price."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        _div(k, ROWS_PER_QUESTION).alias("question"),
        F.concat(F.lit("q"), _div(k, ROWS_PER_QUESTION).cast("string")).alias("qid"),
        (k % ROWS_PER_QUESTION).cast("int").alias("row_no"),
        F.array(k.cast("string"), "p_type", F.col("p_retailprice").cast("string")).alias("cells"),
        F.col("p_retailprice").alias("price"),
    )


def answer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs answer every golden table, each answer damaged in one of eight ways (``mode``)."""
    golden = golden_tables(spark, sf_dir)
    runs = golden.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(PART_RUNS - 1))))
    mode = (F.col("r") + F.col("question")) % 8
    factor = F.when(mode == 2, 1.0005).when(mode == 3, 1.005).when(mode == 4, 1.5).otherwise(1.0)
    price = (F.col("price") * factor).cast("string")
    key, kind = F.col("cells")[0], F.col("cells")[1]
    ragged = (mode == 6) & (F.col("row_no") == 3)
    cells = (
        F.when(mode == 1, F.array(price, key, F.upper(kind)))
        .when(ragged, F.array(key, kind, price, F.lit("?")))
        .otherwise(F.array(key, kind, price))
    )
    made = runs.select(
        F.concat(F.lit("r"), F.col("r").cast("string")).alias("run"), "qid",
        (ROWS_PER_QUESTION - F.col("row_no")).cast("int").alias("row_no"), cells.alias("cells"), mode.alias("mode"),
    )
    return made.filter((F.col("mode") != 7) & ~((F.col("mode") == 5) & (F.col("row_no") == 1)))


def expected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = golden_tables(spark, sf_dir).select("question", "qid").distinct()
    runs = asked.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(PART_RUNS - 1))))
    return runs.select(
        F.concat(F.lit("r"), F.col("r").cast("string")).alias("run"), "qid",
        ((F.col("r") + F.col("question")) % 8 != 7).alias("written"),
    )


# -- transcripts -------------------------------------------------------------------

def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as transcript records: one run per user, beats and results by event type."""
    kind, v = F.col("event_type"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("bigint")
    beat = kind.isin("view", "error")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("arrival"), "ts",
        F.when(kind == "click", "assistant").when(kind == "purchase", "result").when(beat, "tool_progress")
        .otherwise("system").alias("type"),
        F.when(kind == "signup", "api_retry").alias("subtype"),
        F.when(kind == "signup", F.when(k % 20 == 1, 401).otherwise(529)).alias("error_status"),
        F.when(k % 5 != 0, F.concat(F.lit("s"), k.cast("string"))).alias("session_id"),
        F.struct(
            F.floor(v * 100).alias("input_tokens"), F.floor(v * 10).alias("output_tokens"),
            F.when(k % 2 == 0, k).alias("cache_creation_input_tokens"), (k * 7).alias("cache_read_input_tokens"),
        ).alias("usage"),
        F.when(beat, (k % 10).cast("string")).alias("tool_use_id"),
        F.when(beat & (k % 7 != 0), F.concat(F.lit("tool"), (k % 3).cast("string"))).alias("tool_name"),
        F.when(beat, F.floor(v)).cast("double").alias("elapsed_time_seconds"),
        F.struct(
            F.when(
                kind == "click",
                F.array(F.struct(F.lit("text").alias("type"), F.lit("-").alias("name")),
                        F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), k.cast("string")).alias("name"))),
            ).alias("content")
        ).alias("message"),
    )


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tool calls and their first shipment as the result."""
    calls = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.struct(F.array(F.struct(
            F.lit("tool_use").alias("type"), F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("tool_use_id"),
            F.lit(None).cast("boolean").alias("is_error"),
        )).alias("content")).alias("message"),
        "o_orderkey",
    )
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").cast("timestamp").alias("ts"), F.bool_or(F.col("l_returnflag") == "R").alias("bad")
    )
    owners = calls.select("run", "o_orderkey")
    results = first.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "run", "ts",
        F.struct(F.array(F.struct(
            F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"),
            F.lit(None).cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("tool_use_id"),
            F.col("bad").alias("is_error"),
        )).alias("content")).alias("message"),
    )
    return calls.drop("o_orderkey").unionByName(results)


def range_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as range reads; a third are cut short."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("route"), (k * 1000).alias("bytes"), F.col("value").alias("total"),
        (k % 3 != 0).alias("complete"), F.when(k % 10 == 3, "timeout").alias("error"),
    )


# -- documents ---------------------------------------------------------------------

def committed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under paths and with contents that a secret scan has to judge."""
    d = F.col("doc_id")
    name = F.when(d % 50 == 7, "/key.pem").when(d % 50 == 8, "/.env").otherwise(".md")
    leak = F.when(d % 37 == 0, F.concat(F.lit("\nsk-ant-"), F.md5("text"))).when(
        d % 41 == 0, F.lit('\n{"accessToken": "a", "refreshToken": "b"}')
    ).when(d % 43 == 0, F.lit('\n{"refreshToken": "b"}'))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), d.cast("string"), name).alias("path"),
        F.concat("text", F.coalesce(leak, F.lit(""))).alias("text"),
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings and fences put in place of lines by their length."""

    def mark(line: Column) -> Column:
        n = F.length(line)
        title = F.concat(F.repeat(F.lit("#"), n % 3 + 1), F.lit(" T"), (n % 23).cast("string"))
        return F.when(n % 17 == 5, "```").when(n % 3 == 1, title).when(n % 7 == 2, "").otherwise(line)

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"),
        F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"),
    )
