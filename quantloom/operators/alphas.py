"""Formula alphas and further factors, as stages of SQL expressions over bars.

A stage adds columns that may use windows over the columns of earlier stages. Ranks over the whole history (`whole_rank`) look ahead: they
rank a row among later ones too, and are offered since users compare with them.

On Spark the formulas run over sorted rows (`rolling.Rows`), all of a family in one pass (`by_rows`): as Spark's own windows they took n
steps a row for each, and a sort for each whole-history rank, all held by one task. The texts say the same for another engine, and for Spark's SQL (`Spark`,
`staged`), as a check.
Correlations are rounded to 9 digits, so that ranks of them don't depend on the last bits of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import windows as W
from ..stored import stored


class Text:
    """Windows over a symbol's rows: a value exists only where the window holds n non-null values."""

    order = "(partition by symbol order by trade_date)"

    def over(self, n: int) -> str:
        return f"(partition by symbol order by trade_date rows between {n - 1} preceding and current row)"

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) over {self.order}"

    def diff(self, x: str, k: int = 1) -> str:
        return f"({x} - {self.lag(x, k)})"

    def full(self, x: str, n: int, agg: str, least: int | None = None) -> str:
        return f"(case when count({x}) over {self.over(n)} >= {least or n} then {agg}({x}) over {self.over(n)} end)"

    def mean(self, x: str, n: int, least: int | None = None) -> str:
        return self.full(x, n, "avg", least)

    def std(self, x: str, n: int) -> str:
        return self.full(x, n, "stddev_samp")

    def var(self, x: str, n: int) -> str:
        return self.full(x, n, "var_samp")

    def total(self, x: str, n: int) -> str:
        return self.full(x, n, "sum")

    def low(self, x: str, n: int) -> str:
        return self.full(x, n, "min")

    def high(self, x: str, n: int) -> str:
        return self.full(x, n, "max")

    def both(self, x: str, y: str, n: int, value: str) -> str:
        return f"(case when count(case when {x} is not null and {y} is not null then 1 end) over {self.over(n)} = {n} then {value} end)"

    def corr(self, x: str, y: str, n: int) -> str:
        w = self.over(n)
        return self.both(x, y, n, f"round(covar_pop({x}, {y}) over {w} / nullif(stddev_pop({x}) over {w} * stddev_pop({y}) over {w}, 0), 9)")

    def cov(self, x: str, y: str, n: int) -> str:
        return self.both(x, y, n, f"covar_samp({x}, {y}) over {self.over(n)}")

    def slope(self, y: str, x: str, n: int) -> str:
        """Of y on x."""
        w = self.over(n)
        return self.both(x, y, n, f"covar_pop({y}, {x}) over {w} / nullif(var_pop({x}) over {w}, 0)")

    def div(self, a: str, b: str) -> str:
        return f"(({a}) / nullif({b}, 0))"

    def pct(self, x: str, k: int) -> str:
        return f"({x} / nullif({self.lag(x, k)}, 0) - 1)"

    def whole_rank(self, x: str) -> str:
        """Percent rank among all of the symbol's rows, earlier and later; average ties."""
        return f"(case when {x} is not null then (rank() over (partition by symbol order by {x} nulls last) + (count(*) over (partition by symbol, {x}) - 1) / cast(2 as double)) / count({x}) over (partition by symbol) end)"

    def ts_rank(self, x: str, n: int, percent: bool = True) -> str:
        """Rank, with average ties, of the last of n values."""
        rank = f"({self.count_if(x, n, '<')} + ({self.count_if(x, n, '=')} + 1) / cast(2 as double))"
        return f"(case when count({x}) over {self.over(n)} = {n} then {rank}{f' / {n}' if percent else ''} end)"


class Spark(Text):
    def count_if(self, x: str, n: int, sign: str) -> str:
        return f"size(filter(collect_list({x}) over {self.over(n)}, e -> e {sign} {x}))"

    def argmax(self, x: str, n: int) -> str:
        return f"(case when count({x}) over {self.over(n)} = {n} then array_position(collect_list({x}) over {self.over(n)}, max({x}) over {self.over(n)}) - 1 end)"

    def skew(self, x: str, n: int) -> str:
        return f"({self.full(x, n, 'skewness')} * {(n * (n - 1)) ** 0.5 / (n - 2)!r})"

    def kurt(self, x: str, n: int) -> str:
        return f"(({self.full(x, n, 'kurtosis')} * {float(n + 1)!r} + 6) * {(n - 1) / ((n - 2) * (n - 3))!r})"


class Duck(Text):
    def count_if(self, x: str, n: int, sign: str) -> str:
        return f"len(list_filter(list({x}) over {self.over(n)}, lambda e: e {sign} {x}))"

    def argmax(self, x: str, n: int) -> str:
        return f"(case when count({x}) over {self.over(n)} = {n} then list_position(list({x}) over {self.over(n)}, max({x}) over {self.over(n)}) - 1 end)"

    def skew(self, x: str, n: int) -> str:
        return self.full(x, n, "skewness")

    def kurt(self, x: str, n: int) -> str:
        return self.full(x, n, "kurtosis")


def base(t: Text) -> list[dict[str, str]]:
    """What the alphas are made of. Columns: o, h, l, c, v."""
    one = {
        "tp": "(h + l + c) / 3",
        "ret": t.pct("c", 1),
        "dc": t.diff("c"),
        "dv": t.diff("v"),
        "dlv2": "ln(v) - " + t.lag("ln(v)", 2),
        "body": "c - o",
        "mv20": t.mean("v", 20),
        "mv10": t.mean("v", 10),
    }
    two = {
        "dtp3": t.diff("tp", 3),
        "dtp6": t.diff("tp", 6),
        "dret3": t.diff("ret", 3),
        "flow": f"{t.total('o', 5)} * {t.total('ret', 5)}",
        "fall": "case when ret < 0 then ret end",
        "size": "abs(body)",
        "up": "case when ret is not null then greatest(ret, 0.0) end",
    }
    three = {"flow10": t.diff("flow", 10), "fall20": f"coalesce({t.std('fall', 20)}, 0.0)", "size5": t.std("size", 5)}
    return [one, two, three]


def ranks(t: Text) -> dict[str, str]:
    return {f"h_{x}": t.whole_rank(x) for x in ("c", "v", "l", "h", "tp", "mv20", "flow10", "dret3", "dtp3", "dtp6")}


def price_alphas(t: Text) -> list[dict[str, str]]:
    """Those that only look back."""
    deviation = "case when ret < 0 then fall20 * fall20 else c end"
    mid = {"x001": deviation, "r3o": t.ts_rank("o", 10), "r3v": t.ts_rank("v", 10), "r4": t.ts_rank("l", 9, False), "r13": f"{t.ts_rank('c', 5)} * {t.ts_rank('v', 5)}", "c38": t.corr("tp", "mv20", 4)}
    low_high = lambda n, x: t.div(f"{x} - {t.low('l', n)}", f"{t.high('h', n)} - {t.low('l', n)}")
    turn = lambda n: f"case when {t.low('dc', n)} > 0 or {t.high('dc', n)} < 0 then dc when {t.low('dc', n)} is not null then -dc end"
    last = {
        "alpha_001": f"{t.argmax('x001', 15)} - 0.5",
        "alpha_002": "-" + t.corr("dlv2", "(body / nullif(o, 0))", 6),
        "alpha_003": "-" + t.corr("r3o", "r3v", 10),
        "alpha_004": "-" + t.ts_rank("r4", 9, False),
        "alpha_006": f"case when mv10 > 0 then -{t.corr('o', 'v', 10)} end",
        "alpha_009": turn(5),
        "alpha_010": turn(4),
        "alpha_012": "sign(dv) * -dc",
        "alpha_013": "-" + t.mean("r13", 5),
        "alpha_016": "-" + t.corr("h", "v", 5),
        "alpha_018": "-" + t.corr("body", "size5", 10),
        "alpha_020": low_high(5, "o"),
        "alpha_022": t.corr("h", "v", 5),
        "alpha_023": t.ts_rank("h", 10),
        "alpha_026": t.ts_rank("c", 20),
        "alpha_027": low_high(5, "c"),
        "alpha_028": t.div("body", f"{t.high('h', 5)} - {t.low('l', 5)}"),
        "alpha_029": f"{t.div('v - ' + t.low('v', 10), t.high('v', 10) + ' - ' + t.low('v', 10))} * {low_high(10, 'c')}",
        "alpha_031": t.corr("ret", "v", 20),
        "alpha_032": "-" + t.mean("ret", 12),
        "alpha_033": t.corr("l", "v", 10),
        "alpha_034": t.corr("h", "v", 10),
        "alpha_036": "-" + t.corr("size", "c", 10),
        "alpha_038": "-" + t.ts_rank("c38", 6),
        "alpha_039": t.div(t.std("v", 20), "mv20"),
        "alpha_041": "-" + t.ts_rank("tp", 3),
        "alpha_042": "-" + t.mean("((o - c) / nullif(c - o, 0))", 10),
        "alpha_043": t.ts_rank("c", 20),
        "alpha_044": t.corr("c", "v", 10),
        "alpha_046": t.div("v", "mv20"),
        "alpha_047": t.corr("body", "v", 10),
        "alpha_067": t.total("ret", 5),
        "alpha_068": t.std("ret", 5),
        "alpha_070": t.skew("ret", 10),
        "alpha_071": t.kurt("ret", 10),
        "alpha_072": t.ts_rank("v", 20),
        "alpha_073": t.ts_rank("o", 10),
        "alpha_074": t.ts_rank("h", 10),
        "alpha_075": t.ts_rank("l", 10),
        "alpha_076": t.ts_rank("c", 20),
        "alpha_077": t.mean("(case when ret > 0 then cast(1 as double) when ret is not null then cast(0 as double) end)", 5),
        "alpha_086": t.div(t.total("up", 10), t.total("abs(ret)", 10)),
        "alpha_087": "-" + t.mean("ret", 10),
        "alpha_088": "-" + t.std("ret", 10),
        "alpha_092": t.ts_rank("amt", 20),
        "alpha_093": t.div("v", "mv10") + " - 1",
        "alpha_094": t.div("c", t.mean("c", 10)) + " - 1",
    }
    return [mid, last]


#: Window of the correlation of whole-history ranks of typical price and volume, and of its rank.
RANKED_CORRELATIONS = {"alpha_011": (5, 4), "alpha_017": (6, 2), "alpha_030": (30, 14), "alpha_035": (4, 10), "alpha_037": (7, 6), "alpha_049": (8, 7), "alpha_050": (10, 10)}


def ranked_alphas(t: Text) -> list[dict[str, str]]:
    """Those with whole-history ranks, which look ahead."""
    mid = {f"k{n}": t.corr("h_tp", "h_v", n) for n in sorted({n for n, _ in RANKED_CORRELATIONS.values()} | {14})}
    mid |= {"k5c": t.corr("h_c", "h_v", 17), "k15": t.corr("h_h", "h_l", 12), "k21": t.corr("h_h", "h_v", 14), "x48": "h_tp - h_dtp3", "r25": t.ts_rank("h_tp", 9)}
    more = {"k21d": t.diff("k21", 2), "h_k5": t.whole_rank("k5")}
    last = {
        "alpha_005": f"{t.ts_rank('k5c', 9)} - 0.5",
        "alpha_007": f"-(h_l - h_h) + {t.corr('h_l', 'h_mv20', 7)}",
        "alpha_008": "-h_flow10",
        "alpha_014": f"-h_dret3 * {t.corr('o', 'v', 10)}",
        "alpha_015": "-" + t.ts_rank("k15", 10),
        "alpha_019": f"-{t.corr('tp', 'mv20', 17)} * h_dtp6",
        "alpha_021": "-" + t.ts_rank("k21d", 17),
        "alpha_024": f"-{t.corr('tp', 'mv20', 6)} * h_dtp3",
        "alpha_025": "case when h_k5 < h_l - r25 then cast(-1 as double) when h_k5 is not null and r25 is not null then cast(0 as double) end",
        "alpha_040": "-k4",
        "alpha_045": "-k5",
        "alpha_048": "-" + t.ts_rank("x48", 10),
    }
    sign = {"alpha_011": "-", "alpha_017": "", "alpha_030": "-", "alpha_035": "-", "alpha_037": "-", "alpha_049": "-", "alpha_050": "-"}
    last |= {name: sign[name] + t.ts_rank(f"k{n}", m) for name, (n, m) in RANKED_CORRELATIONS.items()}
    return [mid, more, last]


def further(t: Text) -> list[dict[str, str]]:
    """Factors beside the registry's: risk, position and distribution. `mret` is the mean return of the date."""
    one = {"ret": t.pct("c", 1), "i": f"cast(row_number() over {t.order} as double)", "obv_step": f"sign({t.diff('c')}) * v"}
    two = {
        "down": "case when ret is not null then least(ret, 0.0) end",
        "rise": "case when ret is not null then greatest(ret, 0.0) end",
        "mret": "avg(ret) over (partition by trade_date)",
        "obv": "sum(obv_step) over (partition by symbol order by trade_date rows between unbounded preceding and current row)",
        "mom20": t.pct("c", 20),
        "mom60": t.pct("c", 60),
    }
    last: dict[str, str] = {f"beta{w}": t.div(t.cov("ret", "mret", w), t.var("mret", w)) for w in (20, 60)}
    last |= {f"asymmetry{w}": f"{t.std('rise', w)} / ({t.std('down', w)} + 1e-8)" for w in (20, 60)}
    last |= {f"price_position{w}": t.div(f"c - {t.low('c', w)}", f"{t.high('c', w)} - {t.low('c', w)}") for w in (20, 60)}
    last |= {f"ret_discrete{w}": f"{t.std('ret', w)} / (abs({t.mean('ret', w)}) + 1e-8)" for w in (5, 20)}
    last |= {f"ma{w}_ratio": t.div("c", t.mean("c", w)) for w in (5, 10, 20, 60)}
    last |= {f"turnover_mc{w}": t.div(t.mean("(c * v)", w), "c") for w in (20, 60)}
    last |= {f"updown_ratio{w}": t.div(t.total("rise", w), f"{t.total('rise', w)} - {t.total('down', w)}") for w in (5, 20)}
    last |= {f"ret_quantile{w}": t.whole_rank(f"mom{w}") for w in (20, 60)}
    last |= {
        "obv_slope20": t.pct("obv", 20),
        "ma_convergence": f"abs({t.div('c', t.mean('c', 5))} - {t.div('c', t.mean('c', 20))}) + abs({t.div('c', t.mean('c', 20))} - {t.div('c', t.mean('c', 60))})",
        "var20": t.var("ret", 20),
        "cov_ret_volume20": t.cov("ret", "v", 20),
        "slope20": t.slope("c", "i", 20),
        "mean20_of_5": t.mean("ret", 20, 5),
    }
    return [one, two, last]


def base_rows(t: R.Rows) -> None:
    o, h, l, c, v = (t.col(x) for x in "ohlcv")
    t.add(tp=(h + l + c) / 3, ret=t.pct("c", 1), dc=t.diff("c"), dv=t.diff("v"), lv=t.ln(v), body=c - o, mv20=t.mean("v", 20), mv10=t.mean("v", 10))
    ret = t.col("ret")
    t.add(
        dlv2=t.diff("lv", 2), dtp3=t.diff("tp", 3), dtp6=t.diff("tp", 6), dret3=t.diff("ret", 3), flow=t.total("o", 5) * t.total("ret", 5), fall=t.when(ret < 0, ret),
        size=t.abs(t.col("body")), up=t.only(t.greatest(ret, 0.0), ret), away=t.abs(ret), rose=t.number(ret > 0), step=t.ratio(t.col("body"), o), back=t.ratio(o - c, c - o),
    )
    t.add(flow10=t.diff("flow", 10), fall20=t.or_else(t.std("fall", 20), 0.0), size5=t.std("size", 5))


def price_rows(t: R.Rows, keep: list[str]) -> dict[str, R.Vec]:
    base_rows(t)
    corr = lambda x, y, n: t.rounded(t.corr(x, y, n), 9)
    low_high = lambda n, x: t.div(t.col(x) - t.low("l", n), t.high("h", n) - t.low("l", n))
    fall20, dc = t.col("fall20"), t.col("dc")

    def turn(n: int) -> R.Vec:
        lo = t.low("dc", n)
        return t.when((lo > 0) | (t.high("dc", n) < 0), dc, t.only(-dc, lo))

    t.add(x001=t.when(t.col("ret") < 0, fall20 * fall20, t.col("c")), r3o=t.ts_rank("o", 10), r3v=t.ts_rank("v", 10), r4=t.ts_rank("l", 9, False), r13=t.ts_rank("c", 5) * t.ts_rank("v", 5), c38=corr("tp", "mv20", 4))
    formulas = {
        "alpha_001": lambda: t.argmax("x001", 15) - 0.5,
        "alpha_002": lambda: -corr("dlv2", "step", 6),
        "alpha_003": lambda: -corr("r3o", "r3v", 10),
        "alpha_004": lambda: -t.ts_rank("r4", 9, False),
        "alpha_006": lambda: t.when(t.col("mv10") > 0, -corr("o", "v", 10)),
        "alpha_009": lambda: turn(5),
        "alpha_010": lambda: turn(4),
        "alpha_012": lambda: t.sign(t.col("dv")) * -dc,
        "alpha_013": lambda: -t.mean("r13", 5),
        "alpha_016": lambda: -corr("h", "v", 5),
        "alpha_018": lambda: -corr("body", "size5", 10),
        "alpha_020": lambda: low_high(5, "o"),
        "alpha_022": lambda: corr("h", "v", 5),
        "alpha_023": lambda: t.ts_rank("h", 10),
        "alpha_026": lambda: t.ts_rank("c", 20),
        "alpha_027": lambda: low_high(5, "c"),
        "alpha_028": lambda: t.div(t.col("body"), t.high("h", 5) - t.low("l", 5)),
        "alpha_029": lambda: t.div(t.col("v") - t.low("v", 10), t.high("v", 10) - t.low("v", 10)) * low_high(10, "c"),
        "alpha_031": lambda: corr("ret", "v", 20),
        "alpha_032": lambda: -t.mean("ret", 12),
        "alpha_033": lambda: corr("l", "v", 10),
        "alpha_034": lambda: corr("h", "v", 10),
        "alpha_036": lambda: -corr("size", "c", 10),
        "alpha_038": lambda: -t.ts_rank("c38", 6),
        "alpha_039": lambda: t.div(t.std("v", 20), t.col("mv20")),
        "alpha_041": lambda: -t.ts_rank("tp", 3),
        "alpha_042": lambda: -t.mean("back", 10),
        "alpha_043": lambda: t.ts_rank("c", 20),
        "alpha_044": lambda: corr("c", "v", 10),
        "alpha_046": lambda: t.div(t.col("v"), t.col("mv20")),
        "alpha_047": lambda: corr("body", "v", 10),
        "alpha_067": lambda: t.total("ret", 5),
        "alpha_068": lambda: t.std("ret", 5),
        "alpha_070": lambda: t.skew("ret", 10),
        "alpha_071": lambda: t.kurt("ret", 10),
        "alpha_072": lambda: t.ts_rank("v", 20),
        "alpha_073": lambda: t.ts_rank("o", 10),
        "alpha_074": lambda: t.ts_rank("h", 10),
        "alpha_075": lambda: t.ts_rank("l", 10),
        "alpha_076": lambda: t.ts_rank("c", 20),
        "alpha_077": lambda: t.mean("rose", 5),
        "alpha_086": lambda: t.div(t.total("up", 10), t.total("away", 10)),
        "alpha_087": lambda: -t.mean("ret", 10),
        "alpha_088": lambda: -t.std("ret", 10),
        "alpha_092": lambda: t.ts_rank("amt", 20),
        "alpha_093": lambda: t.div(t.col("v"), t.col("mv10")) - 1,
        "alpha_094": lambda: t.div(t.col("c"), t.mean("c", 10)) - 1,
    }
    return {name: formulas[name]() for name in keep}


def ranked_rows(t: R.Rows, keep: list[str]) -> dict[str, R.Vec]:
    base_rows(t)
    corr = lambda x, y, n: t.rounded(t.corr(x, y, n), 9)
    t.add(**{f"h_{x}": t.whole_rank(x) for x in ("c", "v", "l", "h", "tp", "mv20", "flow10", "dret3", "dtp3", "dtp6")})
    t.add(**{f"k{n}": corr("h_tp", "h_v", n) for n in sorted({n for n, _ in RANKED_CORRELATIONS.values()} | {14})})
    t.add(k5c=corr("h_c", "h_v", 17), k15=corr("h_h", "h_l", 12), k21=corr("h_h", "h_v", 14), x48=t.col("h_tp") - t.col("h_dtp3"), r25=t.ts_rank("h_tp", 9))
    t.add(k21d=t.diff("k21", 2), h_k5=t.whole_rank("k5"))
    h_k5, h_l, r25 = t.col("h_k5"), t.col("h_l"), t.col("r25")
    made = {
        "alpha_005": t.ts_rank("k5c", 9) - 0.5,
        "alpha_007": -(h_l - t.col("h_h")) + corr("h_l", "h_mv20", 7),
        "alpha_008": -t.col("h_flow10"),
        "alpha_014": -t.col("h_dret3") * corr("o", "v", 10),
        "alpha_015": -t.ts_rank("k15", 10),
        "alpha_019": -corr("tp", "mv20", 17) * t.col("h_dtp6"),
        "alpha_021": -t.ts_rank("k21d", 17),
        "alpha_024": -corr("tp", "mv20", 6) * t.col("h_dtp3"),
        "alpha_025": t.when(h_k5 < h_l - r25, -1.0, t.only(0.0 * h_k5, r25)),
        "alpha_040": -t.col("k4"),
        "alpha_045": -t.col("k5"),
        "alpha_048": -t.ts_rank("x48", 10),
    }
    for name, (n, m) in RANKED_CORRELATIONS.items():
        made[name] = t.ts_rank(f"k{n}", m) if name == "alpha_017" else -t.ts_rank(f"k{n}", m)
    return {name: made[name] for name in keep}


def further_rows(t: R.Rows, keep: list[str]) -> dict[str, R.Vec]:
    c, v = t.col("c"), t.col("v")
    t.add(ret=t.pct("c", 1), i=R.Vec(t.at + 1.0, c.ok | True), cv=c * v, mom20=t.pct("c", 20), mom60=t.pct("c", 60), obv=t.running(t.sign(t.diff("c")) * v))
    ret = t.col("ret")
    t.add(down=t.only(t.least(ret, 0.0), ret), rise=t.only(t.greatest(ret, 0.0), ret))
    ma = lambda w: t.div(c, t.mean("c", w))
    made = {}
    for w in (20, 60):
        made[f"beta{w}"] = t.div(t.cov("ret", "mret", w), t.var("mret", w))
        made[f"asymmetry{w}"] = t.std("rise", w) / (t.std("down", w) + 1e-8)
        made[f"price_position{w}"] = t.div(c - t.low("c", w), t.high("c", w) - t.low("c", w))
        made[f"turnover_mc{w}"] = t.div(t.mean("cv", w), c)
        made[f"ret_quantile{w}"] = t.whole_rank(f"mom{w}")
    for w in (5, 20):
        made[f"ret_discrete{w}"] = t.std("ret", w) / (t.abs(t.mean("ret", w)) + 1e-8)
        made[f"updown_ratio{w}"] = t.div(t.total("rise", w), t.total("rise", w) - t.total("down", w))
    for w in (5, 10, 20, 60):
        made[f"ma{w}_ratio"] = ma(w)
    made |= {
        "obv_slope20": t.pct("obv", 20),
        "ma_convergence": t.abs(ma(5) - ma(20)) + t.abs(ma(20) - ma(60)),
        "var20": t.var("ret", 20),
        "cov_ret_volume20": t.cov("ret", "v", 20),
        "slope20": t.slope("c", "i", 20),
        "mean20_of_5": t.mean("ret", 20, 5),
    }
    return {name: made[name] for name in keep}


#: The lookback of each family, None where it ranks whole histories.
FAMILIES = {"price": (price_rows, 100), "ranked": (ranked_rows, None), "further": (further_rows, None)}


def by_rows(bars: DataFrame, family: str, keep: list[str]) -> DataFrame:
    """The keys and `keep` of a family's formulas, over bars as for `staged`. `further` reads the bars twice, so they are stored for it."""
    formulas, lookback = FAMILIES[family]
    rows = bars.select("symbol", "trade_date", *[F.col(x).cast("double").alias(y) for x, y in zip(("open", "high", "low", "close", "volume", "amount"), "o h l c v amt".split(), strict=True)])
    columns = ["o", "h", "l", "c", "v", "amt"]
    if family == "further":
        rows = stored(rows.withColumn("ret", W.pct_change("c", 1)), "bars")
        mean = rows.groupBy("trade_date").agg(F.avg("ret").alias("mret"))  # a row a date
        rows, columns = rows.join(F.broadcast(mean), "trade_date"), [*columns, "mret"]
    return R.over_rows(rows, columns, keep, lambda t: formulas(t, keep), lookback)


def names_of(stage: dict[str, str]) -> list[str]:
    return list(stage)


def staged(bars: DataFrame, stages: list[dict[str, str]], keep: list[str]) -> DataFrame:
    """bars (symbol, trade_date, open, high, low, close, volume, amount) with the stages' columns; the keys and `keep` of them."""
    out = bars.select("symbol", "trade_date", *[F.col(x).cast("double").alias(y) for x, y in zip(("open", "high", "low", "close", "volume", "amount"), "o h l c v amt".split(), strict=True)])
    for stage in stages:
        out = out.select("*", *[F.expr(text).cast("double").alias(name) for name, text in stage.items()])
    return out.select("symbol", "trade_date", *keep)


def staged_sql(source: str, stages: list[dict[str, str]], last: str) -> str:
    """Named tables for the same; the last is called `last`."""
    text = f"{last}_0 as (select symbol, trade_date, open::double as o, high::double as h, low::double as l, close::double as c, volume::double as v, amount::double as amt from {source})"
    for i, stage in enumerate(stages):
        name = last if i == len(stages) - 1 else f"{last}_{i + 1}"
        text += f",\n{name} as (select *, {', '.join(f'{e} as {n}' for n, e in stage.items())} from {last}_{i})"
    return text
