"""URL filters: allow and block rules, and for all other urls gradient-boosted trees on lexical features.

Everything is DataFrame expressions. The labelled urls are those that a rule
decides. The trees are grown here: the training rows (at most about
``max_train_rows``, drawn by a hash of the url) are a small table of features; each
level of a tree is one aggregation of gradients by (node, feature, bin), at most
nodes x features x bins rows for the driver, which picks the splits of greatest
gain. The finished model is one SQL expression of nested CASEs, so scoring is a
projection inside the scan's stage: no shuffle, no user function.

Features: lengths of url, host and path; depth; share of digits and of letters; Shannon
entropy of the characters; parameters; dots and hyphens of the host; and of the host's
last label (its suffix) the smoothed share of blocked urls among labelled ones. Training
urls are dealt into ``folds`` by hash and get the shares of the other folds, so no url's own
label is in its feature. The suffix table has a row for every suffix of
the training rows, so it is no larger than those, and is broadcast; a suffix that is not
there takes the overall share.

Defined cases: a url that is null or has no :// has empty host and path, fits no rule
and is judged by the model on what there is; with no labelled urls, or none blocked,
the model allows; labels all blocked make it block; repeated rows are judged alike; other
columns come through whatever their names, but those named like the five that are added
are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

#: (action, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FEATURES = ("url_length", "host_length", "path_length", "depth", "digits", "letters", "entropy", "parameters", "dots", "hyphens", "suffix_blocked")


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path added as _host and _path."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("_host", F.coalesce(lower_ascii(host), F.lit(""))).withColumn("_path", F.coalesce(path, F.lit("")))


def deciding_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits _host and _path, else nulls. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        path = "/" + path
        fits = ((F.col("_host") == host) | F.col("_host").endswith("." + host)) & F.col("_path").startswith(path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def suffix() -> Column:
    return F.element_at(F.split("_host", r"\."), -1)


def with_features(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds FEATURES but suffix_blocked, all doubles."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    size = F.length(url)
    safe = F.greatest(size, F.lit(1))
    chars = F.array_distinct(F.split(url, ""))

    def part(c: Column) -> Column:
        share = (size - F.length(F.replace(url, c, F.lit("")))) / safe
        return F.when((c != "") & (share > 0), -share * F.log2(share)).otherwise(0.0)

    values = {
        "url_length": size,
        "host_length": F.length("_host"),
        "path_length": F.length("_path"),
        "depth": F.length("_path") - F.length(F.replace("_path", F.lit("/"), F.lit(""))),
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / safe,
        "letters": F.length(F.regexp_replace(url, "[^A-Za-z]", "")) / safe,
        "entropy": F.aggregate(chars, F.lit(0.0), lambda a, c: a + part(c)),
        "parameters": F.when(F.instr(url, "?") > 0, 1 + F.length(url) - F.length(F.replace(url, F.lit("&"), F.lit("")))).otherwise(0),
        "dots": F.length("_host") - F.length(F.replace("_host", F.lit("."), F.lit(""))),
        "hyphens": F.length("_host") - F.length(F.replace("_host", F.lit("-"), F.lit(""))),
    }
    return rows.withColumns({name: value.cast("double") for name, value in values.items()})


class Leaf:
    def __init__(self, value: float) -> None:
        self.value = value

    def sql(self) -> str:
        return f"{self.value!r}D"


class Split:
    """feature <= cut goes left."""

    def __init__(self, feature: str, cut: float, left: Leaf | Split, right: Leaf | Split) -> None:
        self.feature, self.cut, self.left, self.right = feature, cut, left, right

    def sql(self) -> str:
        return f"CASE WHEN {self.feature} <= {self.cut!r}D THEN {self.left.sql()} ELSE {self.right.sql()} END"


class Boosted:
    """The sum of the trees is the log odds of being blocked."""

    def __init__(self, base: float, trees: list[Leaf | Split]) -> None:
        self.base, self.trees = base, trees

    def log_odds(self) -> Column:
        return F.expr(" + ".join([f"({self.base!r}D)", *(f"({t.sql()})" for t in self.trees)]))


def boost(rows: DataFrame, scratch: Scratch, trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Grows the trees on rows (FEATURES, y): y is 1.0 for blocked."""
    rows = scratch.keep(rows.select("y", *FEATURES).coalesce(8), "training")
    n, blocked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or blocked in (0, n):
        return Boosted(1.0 if n and blocked else -1.0, [])
    quantiles = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({*got[f]}) for f in FEATURES}
    model = Boosted(log(blocked / (n - blocked)), [])
    stacked = F.array(*[F.struct(F.lit(k).alias("feature"), F.expr(f"aggregate(array({', '.join(f'{c!r}D' for c in cuts[f])}), 0, (a, c) -> a + if({f} > c, 1, 0))").alias("bin")) for k, f in enumerate(FEATURES)])
    binned = scratch.keep(rows.withColumn("bins", stacked), "binned")
    for _ in range(trees):
        p = F.lit(1.0) / (1 + F.exp(-model.log_odds()))
        base = binned.withColumn("p", p).withColumn("g", F.col("y") - F.col("p")).withColumn("h", F.col("p") * (1 - F.col("p")))
        path: dict[int, tuple[str, float]] = {}
        totals: dict[int, tuple[float, float]] = {}
        for level in range(depth):
            node = F.lit(1)
            for k in sorted(path):  # heap order: parents first
                f, c = path[k]
                node = F.when(node == k, F.when(F.col(f) <= c, 2 * k).otherwise(2 * k + 1)).otherwise(node)
            hist: dict[int, dict[int, list[tuple[int, float, float]]]] = {}
            here = base.select(node.alias("node"), "g", "h", F.explode("bins").alias("b")).where(F.col("node") >= 1 << level)
            for x in here.groupBy("node", "b.feature", "b.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).orderBy("node", "feature", "bin").collect():
                hist.setdefault(x.node, {}).setdefault(x.feature, []).append((x.bin, round(x.g, 9), round(x.h, 9)))
            for k, by in hist.items():
                g_all, h_all = (sum(x[i] for x in by[0]) for i in (1, 2))
                totals[k] = (g_all, h_all)
                best = (1e-6, "", 0.0, (0.0, 0.0))
                for feature, counts in by.items():
                    g = h = 0.0
                    for b, gb, hb in counts[:-1]:
                        g, h = g + gb, h + hb
                        gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                        if gain > best[0] + 1e-9 and b < len(cuts[FEATURES[feature]]):
                            best = (gain, FEATURES[feature], cuts[FEATURES[feature]][b], (g, h))
                if best[1]:
                    path[k] = best[1:3]
                    g, h = best[3]
                    totals[2 * k], totals[2 * k + 1] = (g, h), (g_all - g, h_all - h)

        def grown(k: int) -> Leaf | Split:
            if k in path:
                return Split(*path[k], grown(2 * k), grown(2 * k + 1))
            g, h = totals.get(k, (0.0, 0.0))
            return Leaf(round(rate * g / (h + ridge), 9))

        model.trees.append(grown(1))
        if 1 not in path:
            break
    return model


ADDED = ("_host", "_path", "_rule", "_verdict", "_score")


class Filter:
    """The trees with the suffix table (suffix, n, blocked) that they were grown with."""

    def __init__(self, model: Boosted, suffixes: DataFrame, overall: float) -> None:
        self.model, self.suffixes, self.overall = model, suffixes, overall

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds FEATURES and _score, the log odds of block, to rows (url, _host, _path)."""
        share = (F.col("blocked") + 10 * self.overall) / (F.col("n") + 10)
        known = self.suffixes.select(F.col("suffix").alias("_known"), share.alias("_share"))
        met = with_features(rows).join(F.broadcast(known), suffix() == F.col("_known"), "left")  # no larger than the training rows
        return met.withColumn("suffix_blocked", F.coalesce("_share", F.lit(self.overall))).withColumn("_score", self.model.log_odds()).drop("_known", "_share")


def train(labelled: DataFrame, max_train_rows: int = 20_000, folds: int = 5) -> Filter:
    """Learns from labelled rows (url, _host, _path, y), y 1.0 for blocked; from about max_train_rows of them if there are more."""
    scratch = Scratch(labelled.sparkSession, "urls")
    n = labelled.count()
    odds = F.pmod(F.xxhash64("url", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(folds)).cast("int")
    sample = scratch.keep(labelled.where(odds <= min(1.0, max_train_rows / max(n, 1))).withColumn("fold", fold).withColumn("suffix", suffix()), "sample")
    counted = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("blocked")]
    suffixes = scratch.keep(sample.groupBy("suffix").agg(*counted), "suffixes")
    seen, blocked = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    overall = blocked / seen if seen else 0.0
    in_fold = sample.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("fold_n"), F.sum("y").alias("fold_blocked"))
    others = (F.col("blocked") - F.col("fold_blocked") + 10 * overall) / (F.col("n") - F.col("fold_n") + 10)
    shares = in_fold.join(suffixes, "suffix").select("suffix", "fold", others.alias("suffix_blocked"))
    return Filter(boost(with_features(sample).join(shares, ["suffix", "fold"]), scratch), suffixes, overall)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", max_train_rows: int = 20_000) -> DataFrame:
    """pages with host, path, rule, verdict and score (the model's log odds of block) under the names ADDED."""
    rule, verdict = deciding_rule(rules)
    rows = pages.select(F.struct(*pages.columns).alias("carried"), F.col(url_col).alias("url"))
    marked = parsed(rows).withColumn("_rule", rule).withColumn("_decided", verdict)
    labelled = marked.where(F.col("_decided").isNotNull()).select("url", "_host", "_path", F.when(F.col("_decided") == "block", 1.0).otherwise(0.0).alias("y"))
    scored = train(labelled, max_train_rows).score(marked)
    scored = scored.withColumn("_verdict", F.coalesce("_decided", F.when(F.col("_score") > 0, "block").otherwise("allow")))
    return scored.select(*[F.col("carried").getField(c).alias(c) for c in pages.columns if c not in ADDED], *ADDED)
