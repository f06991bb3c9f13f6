"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Only DataFrame functions are used, for training as for judging. The labelled table is small by
contract and is trained on as one row of arrays; pages are judged where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Site names of labelled URLs to train from where a caller brings none: sites that are commonly
#: blocked (gambling, adult, pills, advertising, spam, fraud) and ordinary ones, some of which share letters with those.
BLOCKED_SITES = """casino-city casinogames gambling-online gamblingclub xxx-movie xxxmovie trackads ads-tracking ad-network betsonline pill-shop spamhost casino-club mycasino casino4you win-now bigwins winners-club adult-shop adults-only adult-films royalcasino casino777 mega-casinos livecasino casino-bonus bestcasinos slots-casino onlinegambling gamblers-den gamble4free poker-stars24 pokerroom
holdem-poker jackpot-city jackpots-now roulette-live sportbets bets24 bet-now topbets betting-tips livebets freeslots slot-machines megalotto lottery-
winner winbig-cash win-a-prize free-prizes prize-claim cash-giveaway easycash pornhouse free-porn pornvideos porn-stars xxx-clips xxxtube adultcams
adult-dating adultvideos sexchat sex-cams hotsex nude-girls nudes-live escort-girls milf-cams erotic-tube pills4less dietpills pill-store pills-online
cheapmeds cheap-viagra viagra-shop cialis-direct discount-pharmacy nopharma-rx steroids-shop cheap-replica replica-watches gamblers gambling-sites
gamble-now freebet-offers bets-free free-spins xxx-films xxx-pics xxxlive viagra-now viagra4men pills-cheap cheap-tablets poker-online-now online-
poker malware-download malwarez infected-site fake-watches fakebags cheapdrugs adserver bannerads clickads ad-tracker popup-ads popads adclick pixel-
tracking tracking-pixel clicktrack trackers-net adsnetwork ads-cdn spamlinks linkspam spam-mailer spammers bulkmail-spam linkfarm seo-spam content-
farm phishing-kit phish-bank account-verify-login secure-login-verify login-update verify-paypal malware-host malware-drop virus-alert keygen-crack
crackz warez-zone torrent-warez hacked-accounts payday-loans fastloans loan-shark bitcoin-doubler crypto-doubler getrich-quick make-money-fast free-
iphone free-giftcards""".split()
ALLOWED_SITES = """thatcher whatever chatham library gardening weather-report recipes history-museum science travelguide theatre music-school mountainrescue harbour kitchen painting cathedral
northern-rail station orchard lanterns sisterhood weaving engineers encyclopedia dictionary wiki openstreetmap webarchive developer-docs opensource
codehub git-tools rustlang javadocs scala debian linuxkernel database softwareguide blogspot newspaper dailynews herald tribune timesonline observer
chronicle telegraph journal reuters broadcast television radiofrance spiegel lemonde elpais gazette magazine university college highschool faculty
students research lab-notes physics chemistry biology nature-reserve geology astronomy mathematics statistics medicine hospital clinic health dentist
nursing government parliament council police embassy cityhall ministry taxoffice courts elections citizens charity redcross foundation unesco europe
bakery restaurant coffeehouse vineyard cheese-shop bookstore bookshop shoes clothing cashmere wool-store furniture carpenter plumber electrician
hardware toolshop bicycle carparts auto-repair railways airline airport hotels hostel campsite football cricket tennis athletics swimming cycling
marathon chessclub olympics stadium music-hall musicals museumshop warehouse greenhouse spotlight spotless cashews cashier wholesale rowing hiking
climbing skiing sailing winters betty-crocker alphabet tibet-tours better-homes photography camera cinema film-festival gallery sculpture architecture
poetry novels literature comics orchestra jazz opera dance folk-songs choir bank-holiday insurance accountants lawyers notary consulting marketing
recruiting careers jobsearch realestate housing rentals moving family parents children kindergarten toys puzzles birthdays wedding pets dogs cattle
horses farming tractor seeds flowers forest rivers ocean islands birds whales shopping market storefront fashion jewelry watchmaker clockwork hats
gloves leather textile paper printing stationery thursday anthem thinking thread other mother weathering northeast together there where theory nation
mention ratio edition tradition eaten heater shed handle sandals stand adventures addresses roadside headlines leads heads shadows threads pad-thai
traditional canadian academy tracking-hikes racetrack trackfield soundtrack spillway caterpillar pillars pillow sextant essex middlesex sussex
cocktails scunthorpe analysis assassin-history grapes therapist therapists pension discounts freedom freedoms freestyle freeman cheapside windows
winery wings winston clicker-training clickable bannermen popular popcorn linkages loans-museum""".split()
#: How their hosts begin and end, and their paths, dealt alike to both kinds.
STARTS = ("", "www.", "m.", "blog.", "shop.")
ENDS = (".com", ".net", ".org", ".example.com", ".co.uk", ".example.net", ".edu", ".info", ".example.org", ".de", ".io", ".gov")
PATHS = ("/", "/en/12", "/index.html", "/de/345", "/", "/fr/6789/", "/es/21")
LABELLED = tuple((f"http://{STARTS[i % 5]}{name}{ENDS[i % 12]}{PATHS[i % 7]}", blocked) for blocked,
    names in ((1, BLOCKED_SITES), (0, ALLOWED_SITES)) for i, name in enumerate(names))
#: Buckets, lengths of n-grams, and the rounds, step, momentum and L2 penalty of training.
DIMENSIONS, SIZES, ROUNDS, RATE, MOMENTUM, PENALTY = 8192, (3, 4), 200, 4.0, 0.95, 3e-5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) rule that fits: struct(verdict, rule), or null.

    A rule fits its host and all subdomains where the path starts with the rule's. Of two rules
    of one length the later by code point is taken.
    """
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
        F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def features(host: Column, path: Column, dimensions: int = DIMENSIONS) -> Column:
    """Buckets of the distinct character n-grams of ``^host$path``; a text too short has none."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path)
    grams = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in SIZES])
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(dimensions)).cast("int")))


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> tuple[float, list[float]]:
    """Bias and weights of a logistic regression, by gradient descent with momentum on the whole table.

    ``labelled`` has url and blocked (0 or 1; rows with nulls are left out, repeats count) and is
    small: it becomes one row. A feature counts 1 / sqrt(number of features of its URL). Weights
    are sums of rows, so a round only needs the rows' inner products, computed once. With no
    rows, bias and weights are 0.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select(F.col("blocked").cast("double").alias("y"),
        features(host, path, dimensions).alias("x")).filter(F.size("x") > 0)
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("rows")).filter(F.size("rows") > 0)
    near = F.transform("rows", lambda a: F.transform("rows", lambda b: F.size(F.array_intersect(a["x"], b["x"])) / F.sqrt(F.size(a["x"]) * F.size(b["x"]))))
    n = F.size("rows")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)

    def descend(kernel: Column) -> Column:
        none = F.transform("rows", lambda _: F.lit(0.0))
        start = F.struct(F.lit(0.0).alias("bias"), none.alias("alpha"), F.lit(0.0).alias("turn"), none.alias("moves"))

        def step(m: Column, _: Column) -> Column:
            errors = F.transform(kernel, lambda k, i: 1.0 / (1.0 + F.exp(-(m["bias"] + dot(k, m["alpha"])))) - F.get(F.col("rows"), i)["y"])
            found = F.transform(F.array(errors), lambda e: F.struct((MOMENTUM * m["turn"] - rate * F.aggregate(e, F.lit(0.0), lambda t, v: t + v) / n).alias("turn"),
                F.zip_with(F.zip_with(m["moves"], e, lambda v, x: MOMENTUM * v - rate * x / n), m["alpha"], lambda v, a: v - rate * penalty * a).alias("moves")))
            return F.transform(found, lambda g: F.struct((m["bias"] + g["turn"]).alias("bias"), F.zip_with(m["alpha"], g["moves"],
                lambda a, v: a + v).alias("alpha"), g["turn"].alias("turn"), g["moves"].alias("moves")))[0]

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)

    fitted = rows.select("rows", F.transform(F.array(near), descend)[0].alias("m"))
    parts = fitted.select(F.col("m.bias").alias("bias"), F.explode(F.arrays_zip("rows", F.col("m.alpha").alias("alpha"))).alias("r"))
    parts = parts.select("bias", (F.col("r.alpha") / F.sqrt(F.size("r.rows.x"))).alias("w"), F.explode("r.rows.x").alias("j"))
    weights, bias = [0.0] * dimensions, 0.0
    for row in parts.groupBy("j").agg(F.sum("w").alias("w"), F.first("bias").alias("bias")).collect():  # ``dimensions`` rows at most
        weights[row["j"]], bias = row["w"], row["bias"]
    return bias, weights


def block_probability(host: Column, path: Column, bias: float, weights: list[float]) -> Column:
    """The model's probability that a URL is to be blocked."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    x = features(host, path, len(weights))
    total = F.transform(F.array(x), lambda v: F.aggregate(v, F.lit(0.0), lambda t, j: t + F.get(table, j)) / F.sqrt(F.greatest(F.size(v), F.lit(1))))[0]
    return 1.0 / (1.0 + F.exp(-(F.lit(bias) + total)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table."""
    return spark.createDataFrame(list(LABELLED), "url string, blocked int")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, threshold: float = 0.55) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, p_block.

    The longest fitting rule decides; without one the model blocks at ``threshold`` or above, so that a
    host of which the n-grams say little is allowed.
    ``rules`` are (verdict, host, path) and, as the labelled table, are small by contract.

    Nulls: a null url, or one without ``://``, has an empty host and path, which no rule fits,
    and the model sees only its two frame characters: no n-grams, the bias alone. Repeated rows
    are judged as often as they occur; a URL's cost is linear in its length; empty tables give no
    rows; further columns are ignored.
    """
    bias, weights = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("p_block",
        block_probability(F.col("host"), F.col("path"), bias, weights))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "p_block")
