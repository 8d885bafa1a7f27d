"""Table shapes, as DDL: a StructType made from DDL needs a session, which workers do not have."""

from __future__ import annotations

TRADE = "seq long, time long, price double, qty double, quote double"
BAR = "timestamp long, open double, high double, low double, close double, volume double, dollar_volume double, trade_count long"
PANEL = "t long, asset_idx int, asset string, px double"
PAIR = (
    "fold long, ativos array<string>, n_ativos int, vetor_coint array<double>, score_johansen double, p_valor double, estabilidade double, half_life double,"
    " adf_pvalor double, hurst double, variance_ratio double"
)
FUNNEL = "fold long, ativos_inicial long, ativos_pos_corr long, pares_johansen long, pares_pos_bh long, pares_final long"


def names(ddl: str) -> list[str]:
    return [field.split(" ")[0] for field in ddl.split(", ")]
