"""SQL for DuckDB of the clusterings, written out step by step.

Points are a table p(t, id, u, a, b): a group (an image or a tile), a name within it, a
channel pair, and u a number that stands for the order of rows. Every function returns
common table expressions, the last one named c: t, k, m0, m1.
"""

from __future__ import annotations


def uniform(*parts: str) -> str:
    """SQL of channels.hashed_uniform()."""
    return f"((CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) + 1) / 4503599627370497::DOUBLE)"


def _near(centres: str, points: str = "p") -> str:
    """Every point with its nearest centre k and the squared distance d, the first of equals."""
    return f"""SELECT * FROM (
  SELECT {points}.*, {centres}.k, (a - m0) * (a - m0) + (b - m1) * (b - m1) AS d,
         row_number() OVER (PARTITION BY {points}.t, {points}.id ORDER BY (a - m0) * (a - m0) + (b - m1) * (b - m1), {centres}.k) AS nth
  FROM {points} JOIN {centres} USING (t)
) WHERE nth = 1"""


def lloyd(first: str, iterations: int, sigma: float | None = None) -> str:
    """k-means steps from the centres of table `first`; a centre without points stays."""
    weight = "1.0::DOUBLE" if sigma is None else f"(1 - exp(-d / {2 * sigma * sigma}::DOUBLE))"
    out, now = [], first
    for i in range(iterations):
        after = "c" if i == iterations - 1 else f"l{i}"
        out.append(f"n{i} AS MATERIALIZED ({_near(now)})")
        out.append(f"w{i} AS (SELECT t, k, sum({weight}) AS w, sum({weight} * a) AS sa, sum({weight} * b) AS sb FROM n{i} GROUP BY t, k)")
        out.append(
            f"""{after} AS MATERIALIZED (
  SELECT o.t, o.k, CASE WHEN w > 1e-12 THEN sa / w ELSE m0 END AS m0, CASE WHEN w > 1e-12 THEN sb / w ELSE m1 END AS m1 FROM {now} o LEFT JOIN w{i} USING (t, k)
)"""
        )
        now = after
    return ", ".join(out)


def cut(k: int, median: bool, name: str = "c") -> str:
    """Boxes split one by one: the widest channel at its median, or the largest variance at its mean. A box is named by the sides it took."""
    mid, spread = ("median", "max({0}) - min({0})") if median else ("avg", "var_pop({0})")
    of = "greatest(ra, rb)" if median else "(ra + rb) * n"
    out = ["b0 AS (SELECT *, '' AS box FROM p)"]
    for i in range(k - 1):
        out.append(
            f"""s{i} AS MATERIALIZED (
  SELECT t, box, count(*) AS n, {spread.format("a")} AS ra, {spread.format("b")} AS rb, {mid}(a) AS ma, {mid}(b) AS mb FROM b{i} GROUP BY t, box
)"""
        )
        out.append(f"h{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {of} DESC, box) AS nth FROM s{i}) WHERE nth = 1)")
        out.append(
            f"""b{i + 1} AS MATERIALIZED (
  SELECT b.* EXCLUDE (box), CASE WHEN b.box <> h.box THEN b.box WHEN CASE WHEN ra >= rb THEN a <= ma ELSE b <= mb END THEN b.box || '0' ELSE b.box || '1' END AS box
  FROM b{i} b JOIN h{i} h USING (t)
)"""
        )
    out.append(f"{name} AS MATERIALIZED (SELECT t, row_number() OVER (PARTITION BY t ORDER BY box) - 1 AS k, {mid}(a) AS m0, {mid}(b) AS m1 FROM b{k - 1} GROUP BY t, box)")
    return ", ".join(out)


def cells(k: int, per: int, name: str = "c", stretch: float = 0.0, same: bool = False, most: int = 0) -> str:
    """The means of the k fullest cells of a grid with `per` cells an axis, or more (up to `most`) where fewer than k are filled.

    same: one cell size for both channels, that of the wider one.
    """
    width = "greatest({0}, {1})" if same else "greatest({0}, 1e-9)"
    wa = width.format("max(a) - min(a)", "max(b) - min(b)")
    wb = width.format("max(b) - min(b)", "max(a) - min(a)")
    return f"""e AS (SELECT t, min(a) AS la, min(b) AS lb, {wa} * {1 + stretch!r}::DOUBLE AS wa, {wb} * {1 + stretch!r}::DOUBLE AS wb FROM p GROUP BY t),
f AS (SELECT p.*, per, least(floor((a - la) / wa * per), per - 1) AS ca, least(floor((b - lb) / wb * per), per - 1) AS cb FROM p JOIN e USING (t) CROSS JOIN (SELECT unnest(range({per}, {max(per, most) + 1})) AS per)),
r AS (SELECT t, per, ca, cb, count(*) AS n, avg(a) AS m0, avg(b) AS m1, count(*) OVER (PARTITION BY t, per) AS filled FROM f GROUP BY t, per, ca, cb),
o AS (SELECT t, m0, m1, row_number() OVER (PARTITION BY t ORDER BY n DESC, ca, cb) - 1 AS k FROM r SEMI JOIN (SELECT t, min(per) AS per FROM r WHERE filled >= {k} OR per = {max(per, most)} GROUP BY t) USING (t, per)),
{name} AS MATERIALIZED (SELECT t, k, m0, m1 FROM o WHERE k < {k})"""


def by_hash(k: int, name: str = "c") -> str:
    """k points by the order of u."""
    return f"{name} AS MATERIALIZED (SELECT t, k, a AS m0, b AS m1 FROM (SELECT p.*, row_number() OVER (PARTITION BY t ORDER BY u, id) - 1 AS k FROM p) WHERE k < {k})"


def plus_plus(k: int, trials: int, draws: list[str], name: str = "c") -> str:
    """k-means++ by exponential races; draws: SQL of the uniform number of a point for centres 1, 2, ..."""
    out = [by_hash(1, "q0")]
    for i in range(1, k):
        after = name if i == k - 1 else f"q{i}"
        out.append(f"d{i} AS MATERIALIZED ({_near(f'q{i - 1}')})")
        out.append(
            f"""r{i} AS MATERIALIZED (
  SELECT t, a AS ca, b AS cb, nr FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY -ln({draws[i - 1]}) / d, id) AS nr FROM d{i} WHERE d > 0) WHERE nr <= {trials}
)"""
        )
        out.append(f"g{i} AS (SELECT t, nr, ca, cb, sum(least(d, (a - ca) * (a - ca) + (b - cb) * (b - cb))) AS cost FROM d{i} JOIN r{i} USING (t) GROUP BY t, nr, ca, cb)")
        out.append(
            f"""{after} AS MATERIALIZED (
  SELECT * FROM q{i - 1} UNION ALL SELECT t, {i}, ca, cb FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY cost, nr) AS nth FROM g{i}) WHERE nth = 1
)"""
        )
    return ", ".join(out)
