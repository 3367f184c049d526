"""URL filter: rules for hosts and paths, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialise, table

#: (rule as host and path, verdict).
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: URLs that rules label, on which the trees are fitted, at most.
SAMPLE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    part = lambda g: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", g), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule (first by text on ties) whose host is the URL's or a parent domain, and whose path begins the URL's."""
    found = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return found if found is not None else F.lit(None).cast("string")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str, shares: tuple[float, ...]) -> list[float]:
    """Lengths, depth, digit ratio, entropies, numbers of parameters and marks, and how often the host's suffixes are blocked."""
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".")
    return [
        len(url), len(host), len(path), path.count("/"), len(labels),
        sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)),
        entropy(url), entropy(host), len(query.split("&")) if query else 0, "#" in url, url.startswith("https"),
        host.count("-"), path.count("-") + path.count("_"), len(path.strip("/").partition("/")[0]), len(path.rpartition(".")[2]) if "." in path else 0,
        *shares,
    ]


class Trees:
    """Gradient boosting with logistic loss over histograms of at most 32 bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):
            return self
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(p / (1 - p))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree: list = []
            f += self.rate * self._grow(tree, bins, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, bins, cuts, g, h, rows, depth, out) -> np.ndarray:
        at = len(tree)
        tree.append(None)
        best = (1e-9, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for c in range(bins.shape[1]) if depth else ():
            if not len(cuts[c]):
                continue
            sums_g = np.cumsum(np.bincount(bins[rows, c], g[rows], len(cuts[c]) + 1))[:-1]
            sums_h = np.cumsum(np.bincount(bins[rows, c], h[rows], len(cuts[c]) + 1))[:-1]
            gain = sums_g**2 / (sums_h + 1) + (total_g - sums_g) ** 2 / (total_h - sums_h + 1) - total_g**2 / (total_h + 1)
            gain[(sums_h < self.least / 4) | (total_h - sums_h < self.least / 4)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), c, k)
        if best[1] is None:
            tree[at] = float(total_g / (total_h + 1))
            out[rows] = tree[at]
            return out
        left = bins[rows, best[1]] <= best[2]
        first = len(tree)
        self._grow(tree, bins, cuts, g, h, rows[left], depth - 1, out)
        second = len(tree)
        self._grow(tree, bins, cuts, g, h, rows[~left], depth - 1, out)
        tree[at] = (best[1], float(cuts[best[1]][best[2]]), first, second)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)

        def walk(tree, at, rows):
            node = tree[at]
            if isinstance(node, float):
                f[rows] += self.rate * node
                return
            left = x[rows, node[0]] <= node[1]
            walk(tree, node[2], rows[left])
            walk(tree, node[3], rows[~left])

        for tree in self.trees:
            walk(tree, 0, np.arange(len(x)))
        return 1 / (1 + np.exp(-f))


#: How often the last label of the host, its last two, and the path's first part are blocked.
SHARES = ("last_share", "domain_share", "part_share")


def with_shares(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the columns ``SHARES``, from all of ``known`` (``host``, ``path``, ``y``); 0.5 for suffixes that it lacks.

    Rows that are labelled themselves (``y``, if there, isn't null) get the
    shares among hosts of the other half by hash, so no row's own label, nor its
    host's, is in its features.
    """
    labels = F.split("host", r"\.")
    half = F.pmod(F.xxhash64("host"), F.lit(2))
    keys = [F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.split_part(F.ltrim(F.col("path"), F.lit("/")), F.lit("/"), F.lit(1))]
    each = known.select("y", half.alias("half"), F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    sums = [F.sum(F.when(F.col("half") == h, v).otherwise(0)).alias(f"{n}{h}") for h in (0, 1) for n, v in (("blocked", F.col("y")), ("all", F.lit(1)))]
    counts, _ = materialise(each.groupBy("key").agg(*sums), "suffixes")
    share = lambda b, n: (b + 1) / (n + 2)
    labelled = F.col("y").isNotNull() if "y" in rows.columns else F.lit(False)
    for name, key in zip(SHARES, keys, strict=True):
        rows = rows.withColumn("__key", key).join(counts.withColumnRenamed("key", "__key"), "__key", "left")
        other = F.when(half == 0, share(F.col("blocked1"), F.col("all1"))).otherwise(share(F.col("blocked0"), F.col("all0")))
        whole = share(F.col("blocked0") + F.col("blocked1"), F.col("all0") + F.col("all1"))
        rows = rows.withColumn(name, F.coalesce(F.when(labelled, other).otherwise(whole), F.lit(0.5))).drop("__key", "blocked0", "all0", "blocked1", "all1")
    return rows


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (of the trees: 1 is block) of each row.

    The rules judge the URLs that they fit. The others get the verdict of the
    trees, which learn from distinct URLs that the rules label, at most
    ``sample`` of them, chosen by hash; how often each suffix is blocked is
    counted over all labelled rows (for the trees' own rows over hosts of the
    other half) and joined, whatever the number of suffixes. Defined results:
    null and other URLs without ``://`` have an empty host and path and no rule,
    and go to the trees as empty; without any labelled URL the score is 0.5 and
    the verdict allow; a null page_id and repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r for r, v in rules if v == "block"])
    rows = rows.withColumn("y", F.when(F.col("rule").isNotNull(), blocked.cast("int")))
    rows = with_shares(rows, rows.where("y is not null").select("host", "path", "y"))
    got = rows.where("y is not null").select("url", "host", "path", "y", *SHARES).distinct().orderBy(F.xxhash64("url"), "url", "y").limit(sample).collect()
    x = np.array([lexical(r.url, r.host, r.path, [r[c] for c in SHARES]) for r in got], float) if got else np.empty((0, 1))
    sent = spark.sparkContext.broadcast(Trees().fit(x, np.array([r.y for r in got], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            each = zip(*(b.column(c).to_pylist() for c in ("url", "host", "path", *SHARES)), strict=True)
            score = trees.probability(np.array([lexical(*r[:3], r[3:]) for r in each], float))
            names = ["page_id", "url", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    scored = rows.mapInArrow(run, "page_id long, url string, host string, path string, rule string, score double")
    by_rule = F.col("rule").isin([r for r, v in rules if v == "block"])
    return scored.select("page_id", "host", "path", "rule", F.when(F.when(F.col("rule").isNotNull(), by_rule).otherwise(F.col("score") > 0.5), "block").otherwise("allow").alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
