"""Fixed-width tables of a few rows, for the terminal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def fixed_width(df: DataFrame, columns: Sequence[tuple[str, str, str]], limit: int = 100) -> str:
    """Lines of at most ``limit`` rows; ``columns`` are ``(column, title, format)``, like ``("pct", "cov %", "8.1f")``.

    The width of a column is that of its format or title; null is ``n/a``.
    """
    widths = [max(len(title), len(format(0, spec)) if spec[-1] in "dfeg" else len(format("", spec))) for _, title, spec in columns]
    show = lambda v, spec, w: ("n/a" if v is None else format(v, spec)).rjust(w) if spec[-1] in "dfeg" else ("n/a" if v is None else str(v)).ljust(w)
    rows = df.select(*[c for c, _, _ in columns]).limit(limit).collect()
    head = "  ".join(title.ljust(w) if spec[-1] not in "dfeg" else title.rjust(w) for (_, title, spec), w in zip(columns, widths))
    lines = [head, "  ".join("-" * w for w in widths)]
    lines += ["  ".join(show(v, spec, w) for v, (_, _, spec), w in zip(r, columns, widths)) for r in rows]
    return "\n".join(line.rstrip() for line in lines)


EVALUATION = (
    ("variant", "network", "10s"), ("pct_covered", "pt_cov %", "8.2f"), ("neigh_pct", "neigh %", "8.2f"), ("mean_m", "avg_dist m", "10.0f"),
    ("inside_mean_m", "inside m", "10.0f"), ("mass", "KDE mass", "8.4f"),
)
EVALUATION_EXTENDED = (
    ("variant", "network", "10s"), ("pop_gini", "pop_gini", "8.3f"), ("high_need_cov", "need %", "8.1f"), ("track_km", "track_km", "9.1f"), ("pop_per_km", "pop/km", "8.2f"),
    ("mean_transfers", "xfers", "6.2f"), ("pct_0", "0 %", "6.1f"), ("pct_1", "1 %", "6.1f"), ("pct_2_and_more", "2+ %", "6.1f"),
)
