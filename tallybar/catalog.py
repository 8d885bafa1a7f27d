"""Registry of the market-analytics queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybar.operators import bars, multiple, panel, select, stats
from tallybar.plans import summary, walkforward
from tallybar.session import scratch
from tallybar.sources import readers
from tallybar.streaming import bars as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of doubles differ in their last bits from run to run; results are compared to so many places."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- trades: the event stream by type, and by value as price


def trades(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    return shaped(table(spark, sf_dir, "events"), late)


def shaped(events: DataFrame, late: bool = False) -> DataFrame:
    seq = (F.col("event_id") * 7919 % 1000003) if late else F.col("event_id")
    columns = events.select("event_type", seq.alias("tb_seq"), "ts", "value", (F.col("user_id") % 7 + 1).cast("double").alias("qty"))
    return readers.as_trades(columns, "tb_seq", "ts", "value", "qty", by=("event_type",))


TRADES = """trades AS (SELECT event_type, event_id AS seq, epoch_us(ts) // 1000 AS time, value AS price,
    CAST(user_id % 7 + 1 AS DOUBLE) AS qty, value * CAST(user_id % 7 + 1 AS DOUBLE) AS quote FROM events)"""
LATE = TRADES.replace("event_id AS seq", "event_id * 7919 % 1000003 AS seq")


def _bar_sql(length: int, by: str = "", source: str = TRADES, digits: int = 6) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""WITH {source}, w AS (SELECT *, max(time // {length}) OVER ({part} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS wid FROM trades)
    SELECT {keys}CAST(arg_min(time, seq) AS BIGINT) AS timestamp, round(arg_min(price, seq), {digits}) AS open, round(max(price), {digits}) AS high,
    round(min(price), {digits}) AS low, round(arg_max(price, seq), {digits}) AS close, round(sum(qty), {digits}) AS volume,
    round(sum(quote), {digits}) AS dollar_volume, CAST(count(*) AS BIGINT) AS trade_count FROM w GROUP BY {keys}wid"""


@query(_bar_sql(300_000, digits=4))
def time_bars_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.time_bars(trades(spark, sf_dir), "5m"), 4)


@query(_bar_sql(3_600_000, digits=4))
def time_bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.time_bars(trades(spark, sf_dir), "1h"), 4)


@query(_bar_sql(86_400_000, digits=4))
def time_bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.time_bars(trades(spark, sf_dir), "1d"), 4)


@query(_bar_sql(3_600_000, "event_type", digits=4))
def time_bars_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.time_bars(trades(spark, sf_dir), "1h", by=("event_type",)), 4)


@query(_bar_sql(3_600_000, "event_type", LATE, digits=4))
def time_bars_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades in an order far from that of time: late ones join the open bar."""
    return rounded(bars.time_bars(trades(spark, sf_dir, late=True), "1h", by=("event_type",), chunk=5_000), 4)


def _fold_sql(counted: str, threshold: float) -> str:
    return f"""WITH RECURSIVE {TRADES}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS i FROM trades),
    f AS (SELECT event_type, i, CAST(0 AS BIGINT) AS bar, {counted} AS total FROM o WHERE i = 1
      UNION ALL SELECT o.event_type, o.i, CASE WHEN f.total >= {threshold} THEN f.bar + 1 ELSE f.bar END,
        CASE WHEN f.total >= {threshold} THEN 0.0 ELSE f.total END + o.{counted} FROM f JOIN o ON o.event_type = f.event_type AND o.i = f.i + 1)
    SELECT o.event_type, CAST(arg_min(time, seq) AS BIGINT) AS timestamp, round(arg_min(price, seq), 4) AS open, round(max(price), 4) AS high, round(min(price), 4) AS low,
      round(arg_max(price, seq), 4) AS close, round(sum(qty), 4) AS volume, round(sum(quote), 4) AS dollar_volume, CAST(count(*) AS BIGINT) AS trade_count
    FROM o JOIN f ON o.event_type = f.event_type AND o.i = f.i GROUP BY o.event_type, f.bar"""


@query(_fold_sql("qty", 100.0))
def volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.volume_bars(trades(spark, sf_dir), 100.0, by=("event_type",)), 4)


@query(_fold_sql("quote", 5000.0))
def dollar_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.dollar_bars(trades(spark, sf_dir), 5000.0, by=("event_type",)), 4)


def _closed(sql: str, counted: str, threshold: float) -> str:
    """The same without bars that are still open."""
    return f"{sql} HAVING sum({counted}) >= {threshold}"


def streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """All closed bars of the event table read as a stream, by way of a streaming sink."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    where = scratch(spark, "stream")
    made = make(shaped(source))
    made.writeStream.format("parquet").option("path", f"{where}/bars").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{where}/bars")


@query(_closed(_fold_sql("qty", 100.0), "qty", 100.0))
def stream_volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streamed(spark, sf_dir, lambda t: streams.volume_bars(t, 100.0, "event_type")), 4)


@query(_bar_sql(3_600_000, "event_type", digits=4) + " QUALIFY wid < max(wid) OVER (PARTITION BY event_type)")
def stream_time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streamed(spark, sf_dir, lambda t: streams.time_bars(t, "1h", "event_type")), 4)


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS t, CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, value FROM events")
def read_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_series(spark, f"{sf_dir}/events.parquet")


_THRESHOLD_SQL = """WITH {trades}, s AS (SELECT {keys}min(time) AS low, max(time) AS high, sum(qty) AS q, sum(quote) AS d FROM trades {group}),
    e AS (SELECT *, (high - low) // 100 AS each FROM s)
    SELECT {keys}CASE WHEN each >= 86400000 THEN CAST(each // 86400000 AS VARCHAR) || 'd' WHEN each >= 3600000 THEN CAST(each // 3600000 AS VARCHAR) || 'h'
      ELSE CAST(greatest(each // 60000, 1) AS VARCHAR) || 'm' END AS interval, round(q / 100, 4) AS volume_threshold, round(d / 100, 4) AS dollar_threshold FROM e"""


@query(_THRESHOLD_SQL.format(trades=TRADES, keys="", group=""))
def calculate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.calculate_thresholds(trades(spark, sf_dir), 100), 4)


@query(_THRESHOLD_SQL.format(trades=TRADES, keys="event_type, ", group="GROUP BY event_type"))
def calculate_thresholds_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.calculate_thresholds(trades(spark, sf_dir), 100, by=("event_type",)), 4)


@query(f"WITH {TRADES} SELECT event_type, seq, time, round(price, 6) AS price, qty, round(quote, 6) AS quote FROM trades")
def trade_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades(spark, sf_dir))


#: The footer is read from the file, so the statement names the one of the scale at which results are compared.
@query("""SELECT CAST(num_rows AS BIGINT) AS num_rows, CAST(num_row_groups AS BIGINT) AS num_row_groups, (SELECT string_agg(column_name, ',') FROM (DESCRIBE events)) AS column_names
    FROM parquet_file_metadata('/root/testdata/sf0.01/events.parquet')""")
def parquet_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parquet_info(spark, f"{sf_dir}/events.parquet").drop("columns")


# -- panel: days by brand, the price of a unit


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense panel of unit prices by ship date and brand."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cells = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_shipdate").alias("at"), F.col("p_brand").alias("asset")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px")
    )
    brands = cells.select("asset").distinct()
    ahead = brands.select(F.col("asset").alias("b")).join(brands, F.col("asset") <= F.col("b")).groupBy(F.col("b").alias("asset")).agg((F.count(F.lit(1)) - 1).cast("int").alias("asset_idx"))
    return panel.dense(panel.with_row_numbers(cells.join(ahead, "asset").select("at", "asset_idx", "asset", "px")))


PRICES = """cells AS (SELECT l_shipdate AS day, p_brand AS asset, sum(l_extendedprice) / sum(l_quantity) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    brands AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) - 1 AS INTEGER) AS asset_idx FROM (SELECT DISTINCT asset FROM cells)),
    days AS (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS BIGINT) AS t FROM (SELECT DISTINCT day FROM cells)),
    prices AS (SELECT d.t, b.asset_idx, b.asset, c.px FROM days d CROSS JOIN brands b LEFT JOIN cells c ON c.day = d.day AND c.asset = b.asset)"""
RULE = """kept AS (SELECT asset_idx FROM prices GROUP BY 1 HAVING avg(CASE WHEN px IS NULL THEN 1.0 ELSE 0.0 END) < 0.5)"""
CLEAN = f"""{PRICES}, filled AS (SELECT t, asset_idx, asset, coalesce(last_value(px IGNORE NULLS) OVER (PARTITION BY asset_idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(px IGNORE NULLS) OVER (PARTITION BY asset_idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS px FROM prices),
    clean AS (SELECT * FROM filled WHERE px IS NOT NULL)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.clean(prices(spark, sf_dir))


@query(f"WITH {CLEAN} SELECT t, asset_idx, asset, round(px, 8) AS px FROM clean")
def panel_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaned(spark, sf_dir), 8)


@query(f"WITH {PRICES}, {RULE} SELECT t, asset_idx, asset, round(px, 8) AS px FROM prices WHERE asset_idx IN (SELECT asset_idx FROM kept)")
def panel_null_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.null_rule(prices(spark, sf_dir)).select("t", "asset_idx", "asset", "px"), 8)


@query(f"WITH {CLEAN} SELECT t, asset_idx, asset, round(px, 8) AS px FROM clean WHERE asset_idx IN (1, 3)")
def panel_select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.select_columns(cleaned(spark, sf_dir), [1, 3]), 8)


RETURNS = """moved AS (SELECT t, asset_idx, px, lag(px) OVER (PARTITION BY asset_idx ORDER BY t) AS p0 FROM clean),
    rets AS (SELECT t, asset_idx, CASE WHEN abs(p0) > 1e-15 THEN (px - p0) / p0 ELSE 0.0 END AS ret FROM moved WHERE p0 IS NOT NULL)"""


@query(f"WITH {CLEAN}, {RETURNS} SELECT t, asset_idx, round(ret, 6) AS ret FROM rets")
def pct_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.pct_returns(cleaned(spark, sf_dir)).select("t", "asset_idx", "ret"))


@query(f"WITH {CLEAN}, {RETURNS} SELECT t, asset_idx, round(px - p0, 8) AS diff FROM moved WHERE p0 IS NOT NULL")
def first_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.first_diff(cleaned(spark, sf_dir)).select("t", "asset_idx", "diff"), 8)


@query(f"WITH {CLEAN} SELECT t, asset_idx, round(px - avg(px) OVER (PARTITION BY asset_idx), 5) AS centred FROM clean")
def demean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.demean(cleaned(spark, sf_dir)).select("t", "asset_idx", "centred"), 5)


MIN_CORR = 0.05
COUNTS = f"""c AS (SELECT t, asset_idx, ret - avg(ret) OVER (PARTITION BY asset_idx) AS c FROM rets),
    s AS (SELECT a.asset_idx AS i, b.asset_idx AS j, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.t = b.t AND a.asset_idx <= b.asset_idx GROUP BY 1, 2),
    n AS (SELECT i, greatest(sqrt(s), 1e-15) AS norm FROM s WHERE i = j),
    near AS (SELECT s.i, s.j FROM s JOIN n x ON x.i = s.i JOIN n y ON y.i = s.j WHERE s.i <> s.j AND abs(s.s / x.norm / y.norm) >= {MIN_CORR}),
    ends AS (SELECT i AS asset_idx FROM near UNION ALL SELECT j FROM near),
    counts AS (SELECT a.asset_idx, CAST(count(e.asset_idx) AS BIGINT) AS cnt FROM (SELECT DISTINCT asset_idx FROM clean) a LEFT JOIN ends e ON e.asset_idx = a.asset_idx GROUP BY 1)"""
CHOSEN = "chosen AS (SELECT asset_idx, cnt FROM counts ORDER BY cnt DESC, asset_idx LIMIT {n})"


@query(f"WITH {CLEAN}, {RETURNS}, {COUNTS} SELECT asset_idx, cnt FROM counts")
def corr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.correlation_counts(cleaned(spark, sf_dir), MIN_CORR)


@query(f"WITH {CLEAN}, {RETURNS}, {COUNTS}, {CHOSEN.format(n=8)} SELECT asset_idx, cnt FROM chosen")
def corr_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.correlation_prefilter(cleaned(spark, sf_dir), MIN_CORR, 8)


def _combinations(k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = select.correlation_prefilter(cleaned(spark, sf_dir), MIN_CORR, 8)
        return select.combinations(chosen, k).select(F.array_join("combo", ",").alias("combo"), "combo_id")

    return run


_PAIRS = f"WITH {CLEAN}, {RETURNS}, {COUNTS}, {CHOSEN.format(n=8)}"
query(f"{_PAIRS} SELECT a.asset_idx || ',' || b.asset_idx AS combo, CAST(row_number() OVER (ORDER BY a.asset_idx, b.asset_idx) - 1 AS BIGINT) AS combo_id FROM chosen a JOIN chosen b ON a.asset_idx < b.asset_idx", "combinations_2")(
    _combinations(2)
)
query(
    f"{_PAIRS} SELECT a.asset_idx || ',' || b.asset_idx || ',' || c.asset_idx AS combo, CAST(row_number() OVER (ORDER BY a.asset_idx, b.asset_idx, c.asset_idx) - 1 AS BIGINT) AS combo_id"
    " FROM chosen a JOIN chosen b ON a.asset_idx < b.asset_idx JOIN chosen c ON b.asset_idx < c.asset_idx",
    "combinations_3",
)(_combinations(3))

TRAIN, STEP, EMBARGO, SUBS = 504, 252, 5, 5
FOLDS = f"""folds AS (SELECT CAST(k AS BIGINT) AS fold, CAST(k * {STEP} AS BIGINT) AS start FROM (SELECT unnest(generate_series(0, 10000)) AS k)
    WHERE k * {STEP} + {TRAIN + STEP + EMBARGO} <= (SELECT max(t) + 1 FROM clean))"""


@query(f"WITH {CLEAN}, {FOLDS} SELECT fold, start FROM folds")
def fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.fold_table(cleaned(spark, sf_dir), TRAIN, STEP, EMBARGO)


@query(f"WITH {CLEAN}, {FOLDS} SELECT f.fold, c.t - f.start AS rel, c.asset_idx, round(c.px, 8) AS px FROM folds f JOIN clean c ON c.t >= f.start AND c.t < f.start + {TRAIN}")
def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.fold_rows(cleaned(spark, sf_dir), TRAIN, STEP, EMBARGO).select("fold", "rel", "asset_idx", "px"), 8)


@query(
    f"WITH {CLEAN}, {FOLDS}, r AS (SELECT f.fold, CAST((c.t - f.start) // {TRAIN // SUBS} AS INTEGER) AS sub, c.px FROM folds f JOIN clean c ON c.t >= f.start AND c.t < f.start + {TRAIN})"
    f" SELECT fold, sub, CAST(count(*) AS BIGINT) AS n, round(avg(px), 6) AS mean FROM r WHERE sub < {SUBS} GROUP BY 1, 2"
)
def sub_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.sub_windows(panel.fold_rows(cleaned(spark, sf_dir), TRAIN, STEP, EMBARGO), TRAIN, SUBS)
    return rounded(rows.groupBy("fold", "sub").agg(F.count(F.lit(1)).alias("n"), F.avg("px").alias("mean")))


# -- series: values of each event type


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).select("event_type", F.col("seq").alias("t"), F.col("price").alias("x"))


SERIES = "series AS (SELECT event_type, event_id AS t, value AS x FROM events)"


@query(f"""WITH {SERIES}, n AS (SELECT *, lead(x) OVER (PARTITION BY event_type ORDER BY t) AS nx FROM series),
    s AS (SELECT event_type, count(*) AS n, sum(x * (nx - x)) AS sxy, sum(CASE WHEN nx IS NOT NULL THEN x * x END) AS sxx FROM n GROUP BY 1)
    SELECT event_type, CASE WHEN n < 10 OR sxx < 1e-15 THEN CAST('inf' AS DOUBLE) WHEN sxy / sxx >= 0 THEN CAST('inf' AS DOUBLE) ELSE round(-ln(2) / (sxy / sxx), 6) END AS half_life FROM s""")
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.half_life(series(spark, sf_dir), ("event_type",)))


@query(f"""WITH {SERIES}, d AS (SELECT event_type, x - lag(x, 1) OVER w AS d1, x - lag(x, 10) OVER w AS dk FROM series WINDOW w AS (PARTITION BY event_type ORDER BY t))
    SELECT event_type, CASE WHEN count(*) < 20 OR var_samp(d1) < 1e-12 THEN 1.0 ELSE round(var_samp(dk) / 10 / var_samp(d1), 6) END AS variance_ratio FROM d GROUP BY 1""")
def variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.variance_ratio(series(spark, sf_dir), ("event_type",)))


@query(f"""WITH {SERIES}, p AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM series),
    b AS (SELECT event_type, x, i, n, l.lag, i // l.lag AS blk FROM p JOIN (SELECT unnest(generate_series(2, 100)) AS lag) l ON l.lag <= greatest(2, n // 2) WHERE i // l.lag < n // l.lag),
    c AS (SELECT *, x - avg(x) OVER (PARTITION BY event_type, lag, blk) AS c FROM b),
    w AS (SELECT *, sum(c) OVER (PARTITION BY event_type, lag, blk ORDER BY i ROWS UNBOUNDED PRECEDING) AS w FROM c),
    r AS (SELECT event_type, lag, max(w) - min(w) AS r, sqrt(avg(c * c)) AS sd FROM w GROUP BY event_type, lag, blk),
    m AS (SELECT event_type, lag, avg(r / sd) AS rs FROM r WHERE sd > 1e-12 GROUP BY 1, 2)
    SELECT event_type, round(greatest(0.0, least(1.0, regr_slope(ln(rs), ln(lag)))), 5) AS hurst FROM m WHERE rs > 0 GROUP BY 1""")
def hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = stats.series_arrays(series(spark, sf_dir), ("event_type",))
    return rounded(arrays.select("event_type", stats.hurst_of("series").alias("hurst")), 5)


@query(ORACLES["hurst"])
def hurst_by_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.hurst(series(spark, sf_dir), ("event_type",)), 5)


@query(f"""WITH {SERIES}, n AS (SELECT event_type, x, lead(x) OVER (PARTITION BY event_type ORDER BY t) - x AS d FROM series),
    f AS (SELECT event_type, CAST(regr_count(d, x) AS BIGINT) AS n, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy, regr_sxy(d, x) AS sxy FROM n GROUP BY 1)
    SELECT event_type, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 5) AS t_stat, n FROM f""")
def adf_t_lag0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.adf_t_lag0(series(spark, sf_dir), ("event_type",)), 5)


@query(f"""WITH {SERIES}, n AS (SELECT event_type, x, lead(x) OVER (PARTITION BY event_type ORDER BY t) - x AS d FROM series),
    f AS (SELECT event_type, CAST(regr_count(d, x) AS BIGINT) AS n, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy, regr_sxy(d, x) AS sxy FROM n GROUP BY 1),
    s AS (SELECT event_type, n, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS t FROM f)
    SELECT event_type, CASE WHEN t <= -3.4336 - 5.999 / n - 29.25 / (n * n) THEN '1%' WHEN t <= -2.8621 - 2.738 / n - 8.36 / (n * n) THEN '5%'
      WHEN t <= -2.5671 - 1.438 / n - 4.48 / (n * n) THEN '10%' ELSE 'above' END AS bucket FROM s""")
def adf_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.adf_bucket(series(spark, sf_dir), ("event_type",))


@query()
def adf_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = stats.series_arrays(series(spark, sf_dir), ("event_type",))
    return rounded(arrays.select("event_type", stats.adf_test(stats.checked(F.col("series"))).alias("p_valor")))


@query()
def spread_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = stats.series_arrays(series(spark, sf_dir), ("event_type",))
    return rounded(arrays.select("event_type", stats.spread_quality(stats.checked(F.col("series"))).alias("q")).select("event_type", "q.*"))


# -- tests and corrections

PVALUES = "tests AS (SELECT event_id AS combo_id, event_type, (value % 10) / 10.0 * (value % 10) / 10.0 * 0.2 AS p_valor FROM events)"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("value") % 10
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("combo_id"), "event_type", (part / 10.0 * part / 10.0 * 0.2).alias("p_valor"))


@query(f"""WITH {PVALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p_valor, combo_id) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM tests),
    l AS (SELECT *, max(CASE WHEN p_valor <= CAST(k AS DOUBLE) / m * 0.04 THEN k END) OVER (PARTITION BY event_type) AS last FROM r)
    SELECT combo_id, event_type, coalesce(k <= last, false) AS accepted FROM l""")
def bh_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.benjamini_hochberg(p_values(spark, sf_dir), 0.04, ("event_type",)).select("combo_id", "event_type", "accepted")


@query(f"WITH {PVALUES} SELECT combo_id, event_type, p_valor <= 0.04 / count(*) OVER (PARTITION BY event_type) AS accepted FROM tests")
def bonferroni_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.bonferroni(p_values(spark, sf_dir), 0.04, ("event_type",)).select("combo_id", "event_type", "accepted")


def _ortho(left: str, terms: list[str], name: str) -> str:
    """SQL of `left` less its projections on mutually orthogonal columns."""
    return f"{left} - " + " - ".join(f"{t} * (sum({left} * {t}) OVER g / nullif(sum({t} * {t}) OVER g, 0))" for t in terms) + f" AS {name}"


#: Trace statistic of pairs by projections: ln det is the sum of logarithms of squared lengths of Gram-Schmidt residuals.
#: f1, f2 are the lagged steps, z1, z2, z3 the lagged levels and the ones, d1, d2 the steps.
def _traces(source: str, keys: str = "i, j", prefix: str = "") -> str:
    g, p = f"PARTITION BY {keys}", prefix
    return f"""{p}l AS (SELECT {keys}, t, x - lag(x) OVER o AS d1, y - lag(y) OVER o AS d2, lag(x) OVER o AS z1, lag(y) OVER o AS z2, lag(x) OVER o - lag(x, 2) OVER o AS f1, lag(y) OVER o - lag(y, 2) OVER o AS f2
      FROM {source} WINDOW o AS ({g} ORDER BY t)),
    {p}s0 AS (SELECT *, CAST(1.0 AS DOUBLE) AS z3 FROM {p}l WHERE f1 IS NOT NULL),
    {p}s1 AS (SELECT {keys}, t, d1, d2, z1, z2, z3, f1, {_ortho("f2", ["f1"], "f2")} FROM {p}s0 WINDOW g AS ({g})),
    {p}s2 AS (SELECT {keys}, t, {_ortho("d1", ["f1", "f2"], "a1")}, {_ortho("d2", ["f1", "f2"], "a2")}, {_ortho("z1", ["f1", "f2"], "z1")}, {_ortho("z2", ["f1", "f2"], "z2")}, {_ortho("z3", ["f1", "f2"], "z3")}
      FROM {p}s1 WINDOW g AS ({g})),
    {p}s3 AS (SELECT {keys}, t, a1, a2, z1, {_ortho("z2", ["z1"], "z2")}, {_ortho("z3", ["z1"], "z3")} FROM {p}s2 WINDOW g AS ({g})),
    {p}s4 AS (SELECT {keys}, t, a1, a2, z1, z2, {_ortho("z3", ["z2"], "z3")} FROM {p}s3 WINDOW g AS ({g})),
    {p}s5 AS (SELECT {keys}, t, a1, z1, z2, z3, {_ortho("a2", ["a1"], "a2")}, {_ortho("a1", ["z1", "z2", "z3"], "b1")}, {_ortho("a2", ["z1", "z2", "z3"], "b2")} FROM {p}s4 WINDOW g AS ({g})),
    {p}s6 AS (SELECT {keys}, a1, a2, b1, z1, z2, z3, {_ortho("b2", ["b1"], "b2")} FROM {p}s5 WINDOW g AS ({g})),
    {p}traces AS (SELECT {keys}, count(*) AS n, count(*) * (ln(sum(a1 * a1)) + ln(sum(a2 * a2)) - ln(sum(b1 * b1)) - ln(sum(b2 * b2))) AS trace, {_SHARED} AS shared FROM {p}s6 GROUP BY {keys})"""


#: The sum of the eigenvalues: squared correlations of the orthogonal steps with the orthogonal levels.
_SHARED = " + ".join(f"pow(sum({a} * {z}), 2) / sum({a} * {a}) / sum({z} * {z})" for a in ("a1", "a2") for z in ("z1", "z2", "z3"))
TRACE_PAIRS = "p AS (SELECT a.asset_idx AS i, b.asset_idx AS j, a.t, a.px / 1000 AS x, b.px / 1000 AS y FROM clean a JOIN clean b ON a.t = b.t AND a.asset_idx < b.asset_idx),\n    " + _traces("p")


def _pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace tests of all pairs of assets over all rows."""
    prices_ = cleaned(spark, sf_dir)
    pairs = select.combinations(prices_.select("asset_idx").distinct(), 2).select(F.explode("combo").alias("asset_idx"), F.col("combo")[0].alias("i"), F.col("combo")[1].alias("j"))
    return stats.johansen_test(prices_.join(pairs, "asset_idx"), ("i", "j"))


@query(f"WITH {CLEAN}, {TRACE_PAIRS} SELECT i, j, round(trace, 2) AS trace FROM traces")
def johansen_trace0_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_tests(spark, sf_dir).select("i", "j", F.round(F.col("trace_stats")[0], 2).alias("trace"))


@query(f"WITH {CLEAN}, {TRACE_PAIRS} SELECT i, j, round(trace / 15.4943, 3) AS score FROM traces")
def johansen_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_tests(spark, sf_dir).select("i", "j", F.round("score", 3).alias("score"))


@query(f"""WITH {CLEAN}, {TRACE_PAIRS} SELECT i, j, round(CASE WHEN trace >= 19.9349 THEN 0.005 WHEN trace >= 15.4943 THEN 0.05 - 0.04 * (trace - 15.4943) / (19.9349 - 15.4943)
    WHEN trace >= 13.4294 THEN 0.10 - 0.05 * (trace - 13.4294) / (15.4943 - 13.4294) ELSE 0.50 END, 4) AS p_valor FROM traces""")
def johansen_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_tests(spark, sf_dir).select("i", "j", F.round("p_valor", 4).alias("p_valor"))


@query(f"""WITH {CLEAN}, {TRACE_PAIRS}, e AS (SELECT *, exp(-trace / n) AS rest FROM traces),
    two AS (SELECT *, (shared - sqrt(greatest(shared * shared - 4 * (rest - 1 + shared), 0))) / 2 AS least FROM e)
    SELECT i, j, CAST(CASE WHEN trace <= 15.4943 THEN 0 WHEN -n * ln(1 - least) <= 3.8415 THEN 1 ELSE 2 END AS INTEGER) AS rank, round(-n * ln(1 - least), 2) AS trace1 FROM two""")
def johansen_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and second trace statistic of all pairs; two eigenvalues follow from their sum and from the first statistic."""
    return _pair_tests(spark, sf_dir).select("i", "j", "rank", F.round(F.col("trace_stats")[1], 2).alias("trace1"))


@query()
def johansen_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test of all assets together, with vectors and critical values."""
    return stats.johansen_test(cleaned(spark, sf_dir))


# -- walk-forward


#: The defaults but for the correlation bound, which only ranks the assets.
CONFIG = walkforward.Config(min_corr=MIN_CORR)
#: What the SQL of n_combinations counts.
SMALL = walkforward.Config(passo_dias=STEP, top_n_corr=8, max_ativos=3, min_corr=MIN_CORR)


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price panel made walk-like: standardized by asset, summed up and lifted."""
    from pyspark.sql import Window as W

    own = W.partitionBy("asset_idx")
    scaled = cleaned(spark, sf_dir).withColumn("z", (F.col("px") - F.avg("px").over(own)) / F.stddev_samp("px").over(own))
    return scaled.select("t", "asset_idx", "asset", (F.sum("z").over(own.orderBy("t").rowsBetween(W.unboundedPreceding, 0)) + 1000).alias("px"))


def _walk(spark: SparkSession, sf_dir: str, config: walkforward.Config = CONFIG) -> walkforward.Result:
    return walkforward.walk_forward(walks(spark, sf_dir), config, strict=False)


@query()
def walk_forward_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_walk(spark, sf_dir).detail)


@query()
def walk_forward_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir).funnel


@query()
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_walk(spark, sf_dir).summary)


@query(f"WITH {CLEAN}, {FOLDS} SELECT CAST(count(*) * (8 * 7 // 2 + 8 * 7 * 6 // 6) AS BIGINT) AS n_testes_total FROM folds")
def n_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(_walk(spark, sf_dir, SMALL).n_testes_total).cast("long").alias("n_testes_total"))


_SETS = ", ".join(f"({n}, {select.n_combinations([n], CONFIG.min_ativos, CONFIG.max_ativos)})" for n in range(CONFIG.top_n_corr + 1))


@query(f"""WITH {CLEAN}, sizes AS (SELECT max(t) + 1 AS n, least(count(DISTINCT asset_idx), {CONFIG.top_n_corr}) AS assets FROM clean),
    folds AS (SELECT k FROM (SELECT unnest(generate_series(0, 10000)) AS k) WHERE k * {CONFIG.passo_dias} + {CONFIG.janela_treino_dias + CONFIG.passo_dias + CONFIG.embargo_dias} <= (SELECT n FROM sizes))
    SELECT CAST((SELECT count(*) FROM folds) * coalesce(max(total), 0) AS BIGINT) AS n_testes_total FROM sizes JOIN (VALUES {_SETS}) AS s(assets, total) USING (assets)""")
def n_combinations_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(_walk(spark, sf_dir).n_testes_total).cast("long").alias("n_testes_total"))


#: Pairs only, over the price panel itself: what SQL can follow up to the stability filter.
PAIRS = walkforward.Config(passo_dias=STEP, top_n_corr=8, max_ativos=2, min_corr=MIN_CORR, alpha=0.03)
_FOLD_PAIRS = f"""{FOLDS}, fr AS (SELECT f.fold, c.t - f.start AS t, c.asset_idx, c.px FROM folds f JOIN clean c ON c.t >= f.start AND c.t < f.start + {TRAIN}),
    fm AS (SELECT fold, t, asset_idx, px, lag(px) OVER (PARTITION BY fold, asset_idx ORDER BY t) AS p0 FROM fr),
    fc AS (SELECT fold, t, asset_idx, (px - p0) / p0 - avg((px - p0) / p0) OVER (PARTITION BY fold, asset_idx) AS c FROM fm WHERE p0 IS NOT NULL),
    fs AS (SELECT a.fold, a.asset_idx AS i, b.asset_idx AS j, sum(a.c * b.c) AS s FROM fc a JOIN fc b ON a.fold = b.fold AND a.t = b.t AND a.asset_idx <= b.asset_idx GROUP BY 1, 2, 3),
    fn AS (SELECT fold, i, greatest(sqrt(s), 1e-15) AS norm FROM fs WHERE i = j),
    near AS (SELECT s.fold, s.i, s.j FROM fs s JOIN fn x ON x.fold = s.fold AND x.i = s.i JOIN fn y ON y.fold = s.fold AND y.i = s.j WHERE s.i <> s.j AND abs(s.s / x.norm / y.norm) >= {MIN_CORR}),
    ends AS (SELECT fold, i AS asset_idx FROM near UNION ALL SELECT fold, j FROM near),
    counts AS (SELECT a.fold, a.asset_idx, count(e.asset_idx) AS cnt FROM (SELECT DISTINCT fold, asset_idx FROM fr) a LEFT JOIN ends e ON e.fold = a.fold AND e.asset_idx = a.asset_idx GROUP BY 1, 2),
    chosen AS (SELECT fold, asset_idx FROM counts QUALIFY row_number() OVER (PARTITION BY fold ORDER BY cnt DESC, asset_idx) <= {PAIRS.top_n_corr}),
    kept AS (SELECT r.* FROM fr r JOIN chosen c ON c.fold = r.fold AND c.asset_idx = r.asset_idx),
    p AS (SELECT a.fold, a.asset_idx AS i, b.asset_idx AS j, a.t, CAST(a.t // {TRAIN // SUBS} AS INTEGER) AS sub, a.px / 1000 AS x, b.px / 1000 AS y FROM kept a JOIN kept b ON a.fold = b.fold AND a.t = b.t AND a.asset_idx < b.asset_idx),
    {_traces("p", "fold, i, j")}, found AS (SELECT fold, i, j, trace FROM traces WHERE trace > 15.4943)"""


def _pair_walk(spark: SparkSession, sf_dir: str) -> walkforward.Result:
    return walkforward.walk_forward(cleaned(spark, sf_dir), PAIRS, strict=False)


@query(f"""WITH {CLEAN}, {_FOLD_PAIRS}, parts AS (SELECT * FROM p WHERE sub < {SUBS}), {_traces("parts", "fold, i, j, sub", "q")},
    rates AS (SELECT fold, i, j, avg(CASE WHEN trace > 15.4943 THEN 1.0 ELSE 0.0 END) AS rate FROM qtraces GROUP BY 1, 2, 3)
    SELECT f.fold, f.i, f.j, round(f.trace / 15.4943, 3) AS score, round(r.rate, 6) AS estabilidade FROM found f JOIN rates r ON r.fold = f.fold AND r.i = f.i AND r.j = f.j""")
def stability_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fold's pairs of rank above zero with the share of sub-windows in which they are so too."""
    screened = _pair_walk(spark, sf_dir).screened
    return screened.select("fold", F.col("assets")[0].alias("i"), F.col("assets")[1].alias("j"), F.round("score_johansen", 3).alias("score"), F.round("estabilidade", 6).alias("estabilidade"))


@query(f"""WITH {CLEAN}, {_FOLD_PAIRS},
    tests AS (SELECT fold, i, j, CASE WHEN trace >= 19.9349 THEN 0.005 ELSE 0.05 - 0.04 * (trace - 15.4943) / (19.9349 - 15.4943) END AS pv FROM found),
    r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY pv, i, j) AS k, count(*) OVER (PARTITION BY fold) AS m FROM tests),
    lasts AS (SELECT *, max(CASE WHEN pv <= CAST(k AS DOUBLE) / m * {PAIRS.alpha} THEN k END) OVER (PARTITION BY fold) AS last FROM r),
    n AS (SELECT fold, count(*) AS found, sum(CASE WHEN k <= last THEN 1 ELSE 0 END) AS bh FROM lasts GROUP BY 1)
    SELECT f.fold, CAST((SELECT count(DISTINCT asset_idx) FROM clean) AS BIGINT) AS ativos_inicial, CAST((SELECT count(*) FROM chosen c WHERE c.fold = f.fold) AS BIGINT) AS ativos_pos_corr,
      CAST(coalesce(n.found, 0) AS BIGINT) AS pares_johansen, CAST(coalesce(n.bh, 0) AS BIGINT) AS pares_pos_bh FROM folds f LEFT JOIN n ON n.fold = f.fold""")
def walk_forward_funnel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel of pairs, but for its last count, which needs hedge vectors."""
    return _pair_walk(spark, sf_dir).funnel.drop("pares_final")


DETAIL = """detail AS (SELECT event_type || ',' || CAST(user_id % 3 AS VARCHAR) AS ativos, CAST(2 AS INTEGER) AS n_ativos, value AS half_life, value / 500 AS adf_pvalor, (value % 100) / 100 AS hurst,
    value / 300 AS variance_ratio, (value % 10) / 10 AS estabilidade, value / 50 AS score_johansen FROM events)"""
_AGG = {
    "half_life_media": "avg(half_life)", "half_life_std": "coalesce(stddev_samp(half_life), 0)", "half_life_min": "min(half_life)", "half_life_max": "max(half_life)",
    "adf_pvalor_media": "avg(adf_pvalor)", "adf_pvalor_max": "max(adf_pvalor)", "hurst_media": "avg(hurst)", "hurst_std": "coalesce(stddev_samp(hurst), 0)", "hurst_max": "max(hurst)",
    "vr_media": "avg(variance_ratio)", "vr_std": "coalesce(stddev_samp(variance_ratio), 0)", "estabilidade_media": "avg(estabilidade)", "estabilidade_min": "min(estabilidade)",
    "score_johansen_media": "avg(score_johansen)", "score_johansen_min": "min(score_johansen)",
}


@query(f"WITH {DETAIL} SELECT ativos, CAST(count(*) AS BIGINT) AS n_folds_apareceu, min(n_ativos) AS n_ativos, {', '.join(f'round({e}, 6) AS {n}' for n, e in _AGG.items())} FROM detail GROUP BY 1", "summary")
def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a detail table made from events, with a set of assets written as one string."""
    v = F.col("value")
    detail = table(spark, sf_dir, "events").select(
        F.array("event_type", (F.col("user_id") % 3).cast("string")).alias("ativos"), F.lit(2).alias("n_ativos"), v.alias("half_life"), (v / 500).alias("adf_pvalor"), (v % 100 / 100).alias("hurst"),
        (v / 300).alias("variance_ratio"), (v % 10 / 10).alias("estabilidade"), (v / 50).alias("score_johansen"),
    )
    return rounded(summary.summarize(detail).withColumn("ativos", F.array_join("ativos", ",")))
