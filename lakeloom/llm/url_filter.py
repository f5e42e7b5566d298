"""URL verdicts by rules and by gradient-boosted trees on lexical features.

DataFrame and SQL functions only: features are expressions, the trees are
trained on a bounded labelled sample and become nested CASE expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import LOWER, UPPER

FEATURES = ["url_length", "host_length", "depth", "digit_share", "hyphens", "labels", "entropy", "params", "suffix_rate", "vowel_share", "gram_odds"]

#: Letters of a gram, and how many grams have weights at most.
GRAM, GRAMS = 4, 2000

#: Labelled URLs to train from where the caller has none of its own. Hyphens and parameters
#: are as common in one kind as in the other, so that neither decides alone.
SEED_ALLOW = """
https://my-garden.org/roses/pruning?page=2 https://st-marys-school.co.uk/term-dates https://www.town-library.gov/opening-hours?lang=en&view=full https://open-data.city.gov/transport/buses
https://bird-watching.club/species/robin?year=2019 https://the-old-mill.co.uk/menu https://north-shore-rowing.org/about/history?sort=date&page=3 https://www.mountain-rescue.org.uk/news/winter-safety
https://data-structures.dev/trees/red-black?id=14 https://slow-cooking.kitchen/recipes/bean-stew https://re-use.org/workshops/bicycle-repair?term=oak&lang=en&page=2 http://wood-turning.net/lathes/choosing
https://family-history.info/census/1881/how-to-read?page=2 https://museum-of-science.edu/exhibits/steam http://chess-openings.net/sicilian/najdorf?lang=en&view=full https://en-route.travel/rail/night-trains
https://long-distance-paths.org.uk/coast/stage-four?year=2019 http://home-brewing.info/yeast/ale https://city-orchestra.at/programme/spring?sort=date&page=3 https://www.parish-council.gov.uk/minutes/2019-04
https://sea-level.edu/tide-gauges/method?id=14 https://early-music.eu/instruments/viol https://local-history.ca/mills/index.html?term=oak&lang=en&page=2 http://type-theory.edu/lectures/week3.pdf
https://stadt-bibliothek.de/kinder/lesestunde?page=2 https://jean-moulin.fr/biographie https://la-cocina-lenta.es/guisos/lentejas?lang=en&view=full https://www.allotment-society.org/plots/waiting-list
https://linguistics.edu/papers/vowel-shift?year=2019 https://kernelnotes.dev/scheduler/fairness https://tidepools.org/guide/anemones?sort=date&page=3 https://www.parliament.gov/debates/2020/03/11
https://poetryarchive.org/poems/autumn?id=14 https://bakersforum.com/viewtopic?t=4821 https://encyclopedia.org/wiki/Photosynthesis?term=oak&lang=en&page=2 http://astronomy.edu/courses/101/notes.html
https://villagehall.co.uk/events/quiz?page=2 https://recipes.kitchen/soup/leek https://council.gov.au/waste/collection?lang=en&view=full https://jazzradio.fm/schedule
https://gazette.com/2021/05/14/bridge-reopens?year=2019 https://railways.info/timetables/branch-line http://cyclist.ie/routes/coast?sort=date&page=3 https://treesurvey.org/oaks
https://algebra.edu/rings/ideals?id=14 https://hospital.nhs.uk/wards/visiting https://dictionary.com/browse/heather?term=oak&lang=en&page=2 https://opera.it/stagione/calendario
https://mathforum.net/thread/induction-proof?page=2 https://weather.gov/forecast?zip=02139 https://pottery.studio/glazes/celadon?lang=en&view=full https://books.com/search?q=middlemarch
https://firedepartment.gov/safety/smoke-alarms?year=2019 https://kayaking.nz/rivers/grades http://fungi.info/keys/boletes?sort=date&page=3 https://www.cathedral.org/choir/evensong
https://quilting.com/patterns/log-cabin?id=14 https://universidad.edu/biblioteca/horario https://zeitung.de/kultur/theater?term=oak&lang=en&page=2 https://jardin.fr/potager/tomates
http://www.orchard.com/apples/varieties?page=2 http://ferns.com/fronds/12 https://www.beekeeping.org/hives/7?lang=en&view=full http://harbour.com/tides/2
"""
SEED_BLOCK = """
http://casino-royal-77.top/play http://best-casino-bonus.xyz/win?ref=9 https://win-big-now-777.club/a/1 http://cheap-meds-4u.biz/buy/22?src=mail
http://buy-pills-online.net/order https://no-rx-pharmacy.info/shop?aff=90&c=2 http://free-bets-today.win/go https://sport-bets-24.bet/odds?u=22&v=1
http://seo-link-farm.xyz/x/1 http://ad-click-track.top/c?u=1&v=2&w=3 http://fast-loan-5min.loan/apply http://payday-cash-now.net/apply?ref=51
http://hot-dates-near-you.date/join https://live-cams-xxx.cam/live?m=12 http://prize-claim-2020.win/t https://lucky-spin-88.club/spin?ref=x
http://cheap-watches.net/shop http://replica-bags.net/sale?ref=31 http://secure-login-account-update.com/verify http://click-bonus.net/870?ref=2
http://get-rich.net/5 http://weight-loss.net/9?ref=1 https://free-gift-cards-generator.tk/claim http://crypto-double-eth.io/send?w=9
http://work-from-home.net/2 http://your-parcel-fee.info/pay?id=118 https://miracle-cure.biz/offer http://cash-fast.net/apply?ref=3
http://casinoroyal777.top/play http://bestslots88.xyz/win?r=41 http://x7k2q9vv.top/a http://qzxwvk4411.ru/go.php?id=993
http://cheapviagra24.biz/buy http://pillsnorx99.info/order?aff=71 http://1xbet777win.club/odds http://bet365bonus.win/go?id=12&s=2
http://w4tch3s0utlet.shop/sale http://loan5min.loan/apply?src=b&id=44 http://fr33g1fts.tk/claim http://hotcams69.cam/live?m=4
http://btcdoubler2x.io/send http://kjh3489dfg.cn/p/8812?z=1 http://adtrk77.com/c http://clk9.net/r?u=771&o=12&s=3
http://getfollowers1k.com/buy http://mlmcash4you.biz/join?sponsor=991 http://vip888slots.vip/reg http://p0rnhubz.xxx/watch?v=88&p=4
http://bnkverify0nline.com/login http://prizewinner2021.win/t?id=1&c=77 http://dlcrack4free.ru/setup.exe http://z8y7x6.pw/q?e=5&f=6
http://serialkeygen5.to/dl http://spinlucky7.club/s?r=66 http://ezmoney99.biz/start http://rx4less.su/cart?item=81&q=1
http://diet247pills.info/offer http://trk0a9.link/7f3e?cid=883&sid=9 http://fastcash365.loan/get http://seobacklinks5k.com/order?p=9&ref=1
http://cheapmeds.net/8 http://freebets.net/4?ref=3 http://luckyspins.net/6 http://pokerwin.net/2?ref=6
"""
#: (url, 1 = block).
SEED_URLS = [(url, 0) for url in SEED_ALLOW.split()] + [(url, 1) for url in SEED_BLOCK.split()]


def host_of(url) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at.isNull() | (at == 0), F.lit("")).otherwise(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER))


def path_of(url) -> Column:
    """After the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at.isNull() | (at == 0), F.lit("")).otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) by the longest fitting rule, over columns ``host`` and ``path``.

    A rule is (host, path prefix, verdict), written as host + path; it fits its
    host and all subdomains. Of equally long rules the first in order of text wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams_of(host, path) -> Column:
    """Distinct runs of ``GRAM`` letters in the words of host, without its last label, and path."""
    text = F.concat(F.regexp_replace(F.coalesce(host, F.lit("")), r"\.[^.]*$", ""), F.lit(" "), F.translate(F.coalesce(path, F.lit("")), UPPER, LOWER))
    words = F.filter(F.split(text, "[^a-z]+"), lambda w: F.length(w) >= GRAM)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (GRAM - 1)), lambda i: F.substr(w, i, F.lit(GRAM))))))


def features(urls: DataFrame, suffix_rates: DataFrame | None, gram_odds: dict[str, float] | None = None) -> DataFrame:
    """Lexical features of column ``url`` (with ``host`` and ``path``), added as columns; null URLs count as empty.

    ``suffix_rates`` (suffix, suffix_rate) comes from the bounded training
    sample and has at most one row for each of its rows. ``gram_odds`` are at
    most ``GRAMS`` weights of that sample.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda col, chars: F.length(col) - F.length(F.translate(col, chars, ""))
    letters = F.greatest(F.length("host"), F.lit(1))
    name = F.coalesce(F.col("host"), F.lit(""))
    kinds = F.array_distinct(F.filter(F.split(name, ""), lambda c: c != ""))
    entropy = F.aggregate(
        F.transform(kinds, lambda c: (F.length(name) - F.length(F.replace(name, c, F.lit("")))) / letters), F.lit(0.0), lambda acc, p: acc - p * F.log2(p)
    )
    odds = F.lit(0.0)
    if gram_odds:
        weights = F.create_map(*(F.lit(x) for item in sorted(gram_odds.items()) for x in item))
        odds = F.aggregate(grams_of(F.col("host"), F.col("path")), odds, lambda acc, g: acc + F.coalesce(F.try_element_at(weights, g), F.lit(0.0)))
    out = urls.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        (count(url, "0123456789") / F.greatest(F.length(url), F.lit(1))).alias("digit_share"),
        count(F.col("host"), "-").cast("double").alias("hyphens"),
        count(F.col("host"), ".").cast("double").alias("labels"),
        entropy.alias("entropy"),
        count(url, "=").cast("double").alias("params"),
        (count(F.col("host"), "aeiou") / letters).alias("vowel_share"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        odds.alias("gram_odds"),
    )
    if suffix_rates is None:
        return out.withColumn("suffix_rate", F.lit(0.5))
    return out.join(F.broadcast(suffix_rates), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(0.5)))


def boosted_trees(rows: list[tuple[list[float], int]], trees: int = 20, depth: int = 3, rate: float = 0.3) -> tuple[float, list]:
    """Logistic gradient boosting with exact splits; a tree is a leaf value or (feature, limit, left, right)."""
    positive = sum(y for _, y in rows)
    start = math.log((positive + 1) / (len(rows) - positive + 1))
    scores = [start] * len(rows)
    forest = []

    def grow(members, grads, hess, level):
        g, h = sum(grads[i] for i in members), sum(hess[i] for i in members)
        leaf = rate * g / (h + 1.0)
        if level == 0 or len(members) < 4:
            return leaf
        best = (1e-6, None)
        for f in range(len(FEATURES)):
            order = sorted(members, key=lambda i: rows[i][0][f])
            gl = hl = 0.0
            for a, b in zip(order, order[1:]):
                gl, hl = gl + grads[a], hl + hess[a]
                x, nxt = rows[a][0][f], rows[b][0][f]
                if x < nxt:
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, (x + nxt) / 2))
        if best[1] is None:
            return leaf
        f, limit = best[1]
        return (f, limit, grow([i for i in members if rows[i][0][f] <= limit], grads, hess, level - 1), grow([i for i in members if rows[i][0][f] > limit], grads, hess, level - 1))

    def value(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = grow(list(range(len(rows))), [y - q for (_, y), q in zip(rows, p)], [q * (1 - q) for q in p], depth)
        forest.append(tree)
        scores = [s + value(tree, x) for s, (x, _) in zip(scores, rows)]
    return start, forest


def score_column(model: tuple[float, list]) -> Column:
    """The forest's log-odds of "block" as one expression over the feature columns."""

    def expression(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(F.col(FEATURES[tree[0]]) <= F.lit(tree[1]), expression(tree[2])).otherwise(expression(tree[3]))

    out = F.lit(model[0])
    for tree in model[1]:
        out = out + expression(tree)
    return out


def train(labelled: DataFrame, bound: int = 20_000) -> tuple[tuple[float, list], DataFrame, dict[str, float]]:
    """Fit on at most ``bound`` rows of ``labelled`` (url, label; 1 = block), those whose URL hashes lowest.

    Returns the model, the suffix statistics (the share of blocked URLs of each
    top-level label, shrunk towards one half) and the log-odds of letter grams.
    A row's own label does not count in the statistics that it is trained with.
    """
    named = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label"))
    sample = named.orderBy(F.xxhash64("url"), "url", "label").limit(bound).select("url", "label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    spark = labelled.sparkSession
    rows = features(sample, None).select(*FEATURES, "label", "suffix", grams_of(F.col("host"), F.col("path")).alias("grams")).collect()
    suffixes, grams = statistics(rows)
    rates = {s: suffix_rate(n) for s, n in suffixes.items()}
    odds = {g: gram_weight(n) for g, n in grams.items() if sum(n) > 1}
    odds = dict(sorted(odds.items(), key=lambda x: (-abs(x[1]), x[0]))[:GRAMS])
    return boosted_trees(vectors(rows)), spark.createDataFrame(sorted(rates.items()), "suffix string, suffix_rate double"), odds


def statistics(rows) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """Rows labelled 0 and 1 of each suffix and of each gram."""
    suffixes: dict[str, list[int]] = {}
    grams: dict[str, list[int]] = {}
    for r in rows:
        suffixes.setdefault(r.suffix, [0, 0])[r.label] += 1
        for g in r.grams:
            grams.setdefault(g, [0, 0])[r.label] += 1
    return suffixes, grams


def suffix_rate(n: list[int]) -> float:
    return (n[1] + 2.0) / (sum(n) + 4.0)


def gram_weight(n: list[int]) -> float:
    return math.log((n[1] + 0.5) / (n[0] + 0.5)) if sum(n) else 0.0


def vectors(rows) -> list[tuple[list[float], int]]:
    """Training rows, each with the statistics of the others."""
    suffixes, grams = statistics(rows)
    at, gram_at = FEATURES.index("suffix_rate"), FEATURES.index("gram_odds")
    less = lambda n, label: [n[0] - (label == 0), n[1] - (label == 1)]
    data = []
    for r in rows:
        x = [float(v) for v in r[: len(FEATURES)]]
        x[at] = suffix_rate(less(suffixes[r.suffix], r.label))
        x[gram_at] = sum(gram_weight(less(grams[g], r.label)) for g in sorted(r.grams))
        data.append((x, r.label))
    return sorted(data)


def url_filter(urls: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: id, ``host``, ``path``, ``rule``, ``verdict`` (``allow`` or ``block``), ``score``.

    The longest fitting rule decides; where none fits, the trees do (``score``
    is their log-odds of "block"). Null URLs and those without ``://`` have
    empty host and path and are judged by the trees as empty ones. Repeated
    rows and null ids are judged like any other. An empty table gives an empty
    result.
    """
    spark = urls.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(SEED_URLS, "url string, label int")
    model, suffix_rates, gram_odds = train(labelled)
    rows = urls.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_columns(rules)
    judged = features(rows, suffix_rates, gram_odds).select(id_col, "host", "path", rule.alias("rule"), verdict.alias("by_rule"), score_column(model).alias("score"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
