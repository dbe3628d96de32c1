"""URL filters: rules for hosts and paths, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of URLs (LABELLED, or the caller's), by plain gradient
descent; its weights are rounded to whole thousandths, so sums are exact in any order. Over the pages everything is
Spark's own functions within each row: characters to code points, code points to n-gram buckets, buckets to weights in
one literal array; the ends of a host, label by label, to the rules of that host in one literal table, dealt by hash.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the
end. A rule fits its host and all subdomains if the path begins with the rule's; the longest fitting rule decides, else
the model.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule fits it and the model's bias
decides (allow). Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm.common import lower_ascii, table

#: (host, path, verdict) of the rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BUCKETS, BASE, SIZES = 16381, 257, (3, 4, 5)
ROUNDS, RATE, DECAY, SCALE = 400, 0.5, 0.002, 1000
#: The log odds before anything is known of a URL: one in thirteen is to be blocked.
PRIOR = -2.5
#: The labelled URLs: made up, none of a real host. Fixed values.
BLOCKED = """
https://royal-casino-club.com/en/4410 https://www.luckyslots777.net/de/spin https://onlinecasino24.org/fr/820.html https://m.vegas-casino.com/es/12/
https://casino-jackpots.net/play/bonus https://poker-room-vip.org/en/31 https://blog.casino-bonus-codes.com/de/7 https://www.roulette-casino.net/fr/5
https://megabet365.com/odds/live https://sports-bets-tips.org/en/909 https://best-bets-daily.net/de/44/ https://m.super-bets.com/fr/3 https://www.freebets-bonus.org/es/1
https://betting-odds.net/en/17.html https://win-big-lottery.com/claim/winner https://free-spins-win.org/en/2 https://www.lucky-win.net/de/81 https://win-prizes-free.com/fr/6
https://discount-pills-rx.com/en/501 https://www.diet-pills-now.net/de/6 https://sleeping-pills-buy.org/fr/77.html https://m.blue-pills.com/es/2 https://pills-no-prescription.net/shop
https://cheap-meds-online.org/en/9 https://cheap-viagra.com/order/10mg https://www.cheap-pharmacy.net/de/31/ https://cheap-tramadol-rx.org/fr/1 https://canadian-pharmacy.com/es/55
https://hot-adult-cams.com/en/7 https://www.adult-videos-free.net/de/18 https://adultdating-local.org/fr/2001 https://m.adult-chat.com/es/4 https://xxx-tube.net/en/998
https://pornhd.org/de/video https://escort-x.com/fr/annonces https://sexcams-x.net/es/24 https://x-adult-shop.org/en/61.html
https://ads-server.com/en/5 https://www.popup-ads.net/de/12 https://banner-ads-push.org/fr/468 https://m.video-ads.com/es/3 https://ads-network.net/serve/zone
https://clicktrack.com/en/778 https://www.pixel-track.org/de/1.gif https://user-track.net/fr/9 https://track-clicks.com/es/30/ https://adtrack-media.org/en/41
https://seo-link-farm.com/en/8 https://www.content-farm.net/de/71 https://backlinks-farm.org/fr/4 https://m.click-farm.com/es/16 https://farm-links-seo.net/dir/9
https://spam-blaster.com/en/2 https://www.mail-spam.org/de/40.html https://spamlinks.net/fr/3 https://m.comment-spam.com/es/7 https://spam-traffic.org/buy
https://warez-crack.com/en/61 https://www.keygen-serials.net/download/keygen.exe https://payday-loans-fast.org/apply https://replica-watches.com/de/6 https://fake-login-verify.net/fr/account
"""
ALLOWED = """
https://www.riverside-gazette.com/world/31 https://blog.miriam-writes.org/en/2021 https://docs.library-kit.org/guide/start https://wiki.mountainclub.net/de/history
https://library.northfield.com/catalog/8 https://www.cityofharrow.net/en/minutes https://museum-of-glass.org/fr/visit https://recipes.kitchentable.com/es/rye
https://forum.woodworkers.net/en/120 https://weather.coastal.com/de/7.html https://science-letters.org/en/5.html https://gardening.greenhouse.net/fr/tips
https://travel.slowroads.com/es/madrid https://music.small-records.org/en/12 https://health.county.com/de/6 https://school.westbrook.net/fr/91
https://football.localclub.org/en/88 https://radio.harbour.net/es/4 https://www.thecarpenter.com/en/310 https://shop.bookbarn.com/de/31
https://university-press.org/fr/courses https://www.bergwandern.net/de/17 https://nachrichten.rheinblick.com/de/442 https://www.stadt-bibliothek.org/de/katalog
https://m.lesjardins.net/fr/5989 https://www.cuisine-facile.org/fr/22/ https://journal.provence.com/fr/culture https://www.elcamino.org/es/6964/
https://noticias.valle-verde.com/es/20 https://cocina.abuela.net/es/sopas https://en.birdwatch.org/en/1291 https://theoldmill.com/en/7944.html
https://www.lighthouse-trust.org/en/5397 https://chess.parkside.net/en/88 https://theatre.oldtown.org/fr/3 https://astronomy.skywatch.com/de/4
https://www.trainspotter.net/en/1 https://knitting.woolshop.com/es/14 https://news.harborpost.com/en/2020 https://philosophy.readers.org/de/truth
https://cycling.routes.net/fr/alps https://www.townchoir.org/es/9 https://history.archive.com/en/1843 https://blog.baker.net/fr/61.html
https://photo.lens.org/es/2 https://www.volunteers.org/de/50 https://data.census.net/en/2011 https://support.printers.com/fr/7
https://m.orchard-house.com/de/808 https://www.ferry-lines.net/es/77 https://pottery.clayworks.org/en/3 https://teahouse.com/fr/19/
https://www.windmill-bakery.net/en/33 https://m.stone-bridge.org/de/2 https://lake-district.com/es/610 https://blog.harvest.net/en/45
https://thornton.com/en/6 https://m.northern-star.net/fr/18.html https://blog.sherwood.org/en/230 https://www.trinity.com/de/71/
"""


def labelled() -> list[tuple[str, int]]:
    """(url, 1 if it is to be blocked) of the table."""
    return [(x, y) for part, y in ((BLOCKED, 1), (ALLOWED, 0)) for x in part.split()]


#: The default of what the model is trained on.
LABELLED = tuple(labelled())


def cut(url: str) -> tuple[str, str]:
    """The host and path of a URL, as host_and_path has them."""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def _salt(n: int, part: int) -> int:
    return 2 * n + part


def buckets(host: str, path: str) -> list[int]:
    """The bucket of every n-gram of ^host$ and ^path$; the same as the plan's."""
    found = []
    for part, s in enumerate((f"^{host}$", f"^{path}$")):
        for n in SIZES:
            for i in range(len(s) - n + 1):
                h = _salt(n, part)
                for c in s[i : i + n]:
                    h = (h * BASE + ord(c)) % BUCKETS
                found.append(h)
    return found


@functools.lru_cache(maxsize=8)
def model(table_: tuple[tuple[str, int], ...] = LABELLED) -> tuple[int, tuple[int, ...]]:
    """(bias, weight of each bucket), in thousandths, from (url, label) rows."""
    rows = [(buckets(*cut(url)), y) for url, y in table_]
    rows = [(b, y, 1 / len(b) ** 0.5) for b, y in rows]
    weights = [0.0] * BUCKETS
    seen = sorted({i for b, _, _ in rows for i in b})
    for _ in range(ROUNDS):
        step = dict.fromkeys(seen, 0.0)
        for b, y, size in rows:
            away = 1 / (1 + math.exp(-(PRIOR + size * sum([weights[i] for i in b])))) - y
            for i in b:
                step[i] += away * size
        for i in seen:
            weights[i] -= RATE * (step[i] / len(rows) * 10 + DECAY * weights[i])
    return round(PRIOR * SCALE), tuple(round(w * SCALE) for w in weights)


def scored(url: str, table_: tuple[tuple[str, int], ...] = LABELLED) -> float:
    """The score of one URL in plain Python; over 0 is to be blocked."""
    bias, weights = model(table_)
    found = buckets(*cut(url))
    return sum(weights[i] for i in found) / max(len(found), 1) ** 0.5 + bias


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def _codes(text: Column) -> Column:
    """The code points of ^text$."""
    return F.transform(F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != ""), lambda c: F.ascii(c))


def _grams(codes: str, part: int) -> list[Column]:
    """The buckets of the n-grams of a column of code points, an array for each n."""
    found, size = [], F.size(codes)
    for n in SIZES:
        first = F.lit(_salt(n, part) * BASE)
        h = F.transform(codes, lambda c: (first + c) % BUCKETS)  # noqa: B023
        for j in range(1, n):
            h = F.zip_with(h, F.slice(codes, j + 1, size), lambda x, c: (x * BASE + c) % BUCKETS)
        found.append(F.slice(h, 1, F.greatest(size - n + 1, F.lit(0))))
    return found


_RULE_BUCKETS = 1024


def _rules_table(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The rules as an array of buckets by the crc32 of their host."""
    dealt: list[list[dict[str, str]]] = [[] for _ in range(_RULE_BUCKETS)]
    for host, path, verdict in rules:
        dealt[zlib.crc32(host.encode()) % _RULE_BUCKETS].append({"host": host, "path": path, "verdict": verdict})
    return F.from_json(F.lit(json.dumps(dealt)), "array<array<struct<host:string,path:string,verdict:string>>>")


def _fitting(host: Column, path: Column, rules: Column, labels: int) -> Column:
    """The longest rule that fits, as a struct; labels: how many labels the longest rule's host has."""
    parts = F.slice(F.reverse(F.split(host, r"\.")), 1, labels)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.reverse(F.slice(parts, 1, n)), "."))
    own = F.flatten(F.transform(ends, lambda e: F.filter(F.get(rules, F.pmod(F.crc32(e.cast("binary")), F.lit(_RULE_BUCKETS)).cast("int")), lambda r: (r["host"] == e) & path.startswith(r["path"]))))
    return F.array_max(F.transform(own, lambda r: F.struct(F.length(F.concat(r["host"], r["path"])).alias("n"), F.length(r["host"]).alias("h"), r["host"], r["path"], r["verdict"].alias("verdict"))))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED) -> DataFrame:
    """page_id, host, path, rule, score (the model's sum in thousandths) and verdict.

    Rules (host, path, verdict) and labelled URLs (url, 1 if it is to be blocked) are the caller's lists; both go to every task.
    """
    bias, weights = model(tuple(labelled))
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    weights = F.expr(f"transform(split('{','.join(map(str, weights))}', ','), x -> cast(x as int))")
    known = pages.sparkSession.range(1).select(weights.alias("weights"), _rules_table(tuple(rules)).alias("rules"))
    rows = rows.crossJoin(F.broadcast(known))  # one row: the model and the rules
    labels = max([r[0].count(".") + 1 for r in rules], default=1)
    rows = rows.withColumn("own", _fitting(F.col("host"), F.col("path"), F.col("rules"), labels))
    rows = rows.select("page_id", "host", "path", "own", "weights", _codes(F.col("host")).alias("hc"), _codes(F.col("path")).alias("pc"))
    rows = rows.withColumn("grams", F.concat(*_grams("hc", 0), *_grams("pc", 1))).drop("hc", "pc")
    total = F.aggregate("grams", F.lit(0), lambda s, g: s + F.get(F.col("weights"), g))
    # the bias is held against the sum as the training scaled it: by the root of the number of n-grams
    rows = rows.withColumn("score", total / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double")) + bias)
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.concat("own.host", "own.path").alias("rule"), "score", verdict.alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")


def sql() -> str:
    """The same in DuckDB's SQL."""
    bias, weights = model()
    parts = []
    for part, column in enumerate(("h", "p")):
        for n in SIZES:
            hashed = str(_salt(n, part))
            for j in range(n):
                hashed = f"(({hashed} * {BASE} + unicode(substr({column}, i + {j}, 1))) % {BUCKETS})"
            parts.append(f"list_transform(range(1, greatest(length({column}) - {n - 2}, 1)), lambda i: {hashed})")
    rule = verdict = "NULL"
    for h, p, v in sorted(RULES, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM cut),
    split AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM named),
    marked AS (SELECT *, '^' || host || '$' AS h, '^' || path || '$' AS p FROM split),
    gram AS (SELECT page_id, host, path, {' || '.join(parts)} AS g FROM marked),
    weight AS (SELECT [{', '.join(map(str, weights))}] AS w),
    scored AS (SELECT page_id, host, path, coalesce(list_sum(list_transform(g, lambda x: w[x + 1])), 0) / sqrt(greatest(len(g), 1)::DOUBLE) + {bias} AS score FROM gram, weight)
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM scored
    """
