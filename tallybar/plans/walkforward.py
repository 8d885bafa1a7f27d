"""Walk-forward cointegration: every fold's window, every set of assets, as one lazy plan.

Folds, correlations, corrections and counts are relational. What is numeric is a small dense matrix: a fold's window of
the selected assets (train x top_n numbers) is packed into one row, chunks of sets of assets are dealt over the tasks
with it, and a set's statistic comes from the shared cross products of its window and sub-windows.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybar.functions import kernels
from tallybar.operators import multiple, panel, select
from tallybar.plans.summary import summarize
from tallybar.schema import PAIR, names

LOG = logging.getLogger(__name__)
#: Sets of assets that a task tests for one packed window.
CHUNK = 2_048
#: Consecutive sets, of which those that are left are measured together.
LOT = 512
MIN_ROWS = 60


@dataclass(frozen=True)
class Config:
    """Names and defaults of the reference's options."""

    janela_treino_dias: int = 504
    janela_teste_dias: int = 63
    embargo_dias: int = 5
    passo_dias: int = 63
    min_ativos: int = 2
    max_ativos: int = 7
    min_corr: float = 0.90
    top_n_corr: int = 16
    n_sub_janelas: int = 5
    min_aprovacao: float = 0.75
    correcao_multipla: str = "bh"
    alpha: float = 0.05
    det_order: int = 0
    k_ar_diff: int = 1

    def __post_init__(self) -> None:
        if self.min_ativos < 1 or self.n_sub_janelas < 1 or self.passo_dias < 1:
            raise ValueError("min_ativos, n_sub_janelas and passo_dias must be at least one")
        if self.janela_treino_dias // self.n_sub_janelas < MIN_ROWS:
            LOG.warning("sub-windows have fewer than %d rows: nothing can pass the stability filter", MIN_ROWS)


@dataclass
class Result:
    """detail: a row for each set and fold; funnel: a row for each fold; screened: all sets with rank above zero."""

    detail: DataFrame
    funnel: DataFrame
    summary: DataFrame
    screened: DataFrame
    n_folds: int
    n_testes_total: int
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Free what is kept for detail, funnel and summary, once they have been read."""
        for frame in self.held:
            frame.unpersist()


def pack(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """(fold, assets, names, flat): each fold's window as one flat row-major array, bounded by train x top_n."""
    kept = rows.join(selected.select("fold", "asset_idx"), ["fold", "asset_idx"])
    cells = kept.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("rel", "asset_idx", "px", "asset"))).alias("c"))
    first = F.filter("c", lambda x: x["rel"] == 0)
    return cells.select(
        "fold", F.transform(first, lambda x: x["asset_idx"]).alias("assets"), F.transform(first, lambda x: x["asset"]).alias("names"), F.transform("c", lambda x: x["px"]).alias("flat")
    )


def matrix(flat: np.ndarray, n: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, n)


def chunks(packed: DataFrame, cfg: Config) -> DataFrame:
    """Adds k, low and high: which sets of assets of the fold, in lexicographic order, a row stands for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fold, assets, flat in zip(batch["fold"], batch["assets"], batch["flat"], strict=True):
                for k in range(cfg.min_ativos, min(cfg.max_ativos, len(assets)) + 1):
                    total = math.comb(len(assets), k)
                    out += [(fold, assets, flat, k, low, min(low + CHUNK, total)) for low in range(0, total, CHUNK)]
            yield pd.DataFrame(out, columns=["fold", "assets", "flat", "k", "low", "high"])

    return packed.select("fold", "assets", "flat").mapInPandas(run, "fold long, assets array<int>, flat array<double>, k int, low long, high long").repartition("fold", "k", "low")


def screen(packed: DataFrame, cfg: Config) -> DataFrame:
    """(fold, k, combo_id, places, assets, p_valor, score_johansen, estabilidade) of the sets whose rank is above zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fold, assets, flat, k, low, high in batch[["fold", "assets", "flat", "k", "low", "high"]].itertuples(index=False):
                data = matrix(flat, len(assets))
                sets = np.array(list(itertools.islice(itertools.combinations(range(len(assets)), k), low, high)))
                crit = kernels.critical(k)
                trace = kernels.Moments(data, cfg.det_order, cfg.k_ar_diff).trace(sets)
                found = np.flatnonzero(trace > crit[1])
                if not len(found):
                    continue
                size, passed = len(data) // cfg.n_sub_janelas, np.zeros(len(found))
                if size >= MIN_ROWS:
                    for i in range(cfg.n_sub_janelas):
                        part = kernels.Moments(data[i * size : (i + 1) * size], cfg.det_order, cfg.k_ar_diff)
                        passed += np.nan_to_num(part.trace(sets[found])) > crit[1]
                out += [
                    (fold, k, low + int(i), sets[i].tolist(), [assets[x] for x in sets[i]], kernels.trace_p_value(trace[i], crit), trace[i] / crit[1], p / cfg.n_sub_janelas)
                    for i, p in zip(found, passed, strict=True)
                ]
            yield pd.DataFrame(out, columns=["fold", "k", "combo_id", "places", "assets", "p_valor", "score_johansen", "estabilidade"])

    return chunks(packed, cfg).mapInPandas(run, "fold long, k int, combo_id long, places array<int>, assets array<int>, p_valor double, score_johansen double, estabilidade double")


def measure(stable: DataFrame, packed: DataFrame, cfg: Config) -> DataFrame:
    """Hedge vector and spread statistics of the sets that are left; sets without a finite half-life above zero go.

    Sets of one fold go together in lots, so that the fold's window travels once for each lot.
    """
    schema = f"{PAIR}, combo_id long"
    parts = ("combo_id", "places", "score_johansen", "p_valor", "estabilidade")
    lots = stable.groupBy("fold", "k", F.floor(F.col("combo_id") / LOT).alias("lot")).agg(F.collect_list(F.struct(*parts)).alias("sets"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                data, left, spreads = matrix(r.flat, len(r.names)), [], []
                for combo, places, score, p, share in zip(r.combo_id, r.places, r.score_johansen, r.p_valor, r.estabilidade, strict=True):
                    result = kernels.johansen(data[:, places], cfg.det_order, cfg.k_ar_diff) if len(data) >= MIN_ROWS else None
                    if result is None:
                        continue
                    vector = kernels.hedge_vector(result, len(places))
                    spread = data[:, places] @ vector
                    life = kernels.half_life(spread)
                    if not (life <= 0 or math.isinf(life)):
                        left.append((r.fold, [r.names[i] for i in places], len(places), vector, score, p, share, life, kernels.adf_p_value(spread), kernels.variance_ratio(spread), combo))
                        spreads.append(spread)
                rough = np.concatenate([kernels.hursts(np.array(spreads[i : i + 32])) for i in range(0, len(spreads), 32)]) if spreads else []
                yield pd.DataFrame([(*x[:9], h, *x[9:]) for x, h in zip(left, rough, strict=True)], columns=names(schema))

    met = lots.select("fold", "k", "lot", *[F.col(f"sets.{c}").alias(c) for c in parts]).join(packed.select("fold", "names", "flat"), "fold").repartition("fold", "k", "lot")
    return met.mapInPandas(run, schema).withColumn("vetor_coint", F.transform("vetor_coint", lambda v: F.round(v, 6)))


def walk_forward(prices: DataFrame, cfg: Config | None = None, max_null_fraction: float | None = None, strict: bool = True) -> Result:
    """All folds of a dense panel. strict: too few rows or assets is an error, else the frames are empty."""
    cfg = cfg or Config()
    cleaned = panel.clean(prices, max_null_fraction).persist()
    sizes = cleaned.agg((F.max("t") + 1).alias("rows"), F.count_distinct("asset_idx").alias("assets")).first()
    found, n_assets = sizes["rows"] or 0, sizes["assets"]
    need = cfg.janela_treino_dias + cfg.embargo_dias + cfg.passo_dias
    if strict and found < need:
        raise ValueError(f"{found} rows; one fold needs {need}")
    if strict and n_assets < cfg.min_ativos:
        raise ValueError(f"{n_assets} assets; at least {cfg.min_ativos} are needed")
    folds = panel.fold_table(cleaned, cfg.janela_treino_dias, cfg.passo_dias, cfg.embargo_dias)
    rows = panel.fold_rows(cleaned, cfg.janela_treino_dias, cfg.passo_dias, cfg.embargo_dias)
    selected = select.correlation_prefilter(rows, cfg.min_corr, cfg.top_n_corr, ("fold",))
    packed = pack(rows, selected).persist()
    screened = screen(packed.where(F.size("assets") >= cfg.min_ativos), cfg).persist()
    accepted = multiple.benjamini_hochberg(screened, cfg.alpha, ("fold",), order=("k", "combo_id")) if cfg.correcao_multipla == "bh" else multiple.bonferroni(screened, cfg.alpha, ("fold",))
    stable = accepted.where("accepted").where(F.col("estabilidade") >= cfg.min_aprovacao)
    measured = measure(stable, packed, cfg).persist()
    counts = screened.groupBy("fold").agg(F.count(F.lit(1)).alias("pares_johansen"))
    after = accepted.where("accepted").groupBy("fold").agg(F.count(F.lit(1)).alias("pares_pos_bh"))
    final = measured.groupBy("fold").agg(F.count(F.lit(1)).alias("pares_final"))
    funnel = folds.select("fold").join(packed.select("fold", F.size("assets").cast("long").alias("ativos_pos_corr")), "fold", "left")
    for part in (counts, after, final):
        funnel = funnel.join(part, "fold", "left")
    funnel = funnel.select("fold", F.lit(n_assets).cast("long").alias("ativos_inicial"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ativos_pos_corr", "pares_johansen", "pares_pos_bh", "pares_final")]).orderBy("fold")
    left = [r["ativos_pos_corr"] for r in funnel.select("ativos_pos_corr").collect()]  # one number a fold
    detail = measured.orderBy("fold", "n_ativos", "combo_id").drop("combo_id")
    return Result(detail, funnel, summarize(measured.drop("combo_id")), screened, len(left), select.n_combinations(left, cfg.min_ativos, cfg.max_ativos), (cleaned, packed, screened, measured))
