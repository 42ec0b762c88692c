"""Personal data: base patterns, and boosted trees over further candidates, with DataFrame functions only.

Base spans (e-mail, IPv4, card by Luhn, phone by digit count) are always redacted. High-recall generators propose further
spans that may overlap: obfuscated e-mail addresses, national phone numbers, IPv6 addresses, cards with odd separators, values
assigned to a name that sounds like a secret, and long mixed strings wherever they stand (a fifth kind, `secret`). Boosted
trees score them by format (digits, letters, separators, distinct characters, length, Luhn) and context (cue words before the
span, words that speak against it, an assignment, the characters around it); a span is added if it passes its generator's
threshold, touches no base span, and overlaps no better candidate (by score; then the first, by generator). The trees are compiled into CASE expressions.

The trees learn from sentences made by Spark functions (`TRAINING_ROWS`). A sentence's label, its value and its context are drawn
apart: the same shapes come with both labels, cues and counter-cues stand before some of the wrong ones, so neither tells the
label alone. Each generator's threshold is the least score at which 95 % of the sample's other half are right, and never below 0.5.
A test holds precision and recall on sentences written by hand.

Positions are code points, end exclusive. The patterns are written with possessive quantifiers: they match what the plain ones
match, but a long run costs linear time and no stack; work on a text's spans is done in slices, so that texts with
very many of them do not cost the square of their number. Nulls and edges: a null text is empty; documents without spans
have the hash of the empty string and empty `spans`; repeated rows agree; other columns of the input stay untouched in
`redacted`, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. A local part starts where no character of its kind precedes, or at the end of the last match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no base span of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Generators: kind, pattern, and what a text must have for the pattern to be tried.
GENERATORS = {
    "email_words": ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z0-9-]{1,63}+){1,5}+| at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{1,63}+){1,5}+)", r"(?i)[(\[{ ]at[)\]} ]"),
    "phone_national": ("phone", r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z])", None),
    "ip_six": ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "secret_set": ("secret", r"(?<=(?i:token|secret|passwd|password|passphrase|pwd|apikey|api_key|api-key|access_key|auth|key|bearer)[\"']?\s?[=: ]\s?[\"']?)[A-Za-z0-9+/_.=-]{8,}+", r"(?i)token|secret|pass|pwd|key|auth|bearer"),
    "secret_bare": ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+", None),
    "card_odd": ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_]|  |, )[0-9]{4}(?:[./_]|  |, )[0-9]{4}(?:[./_]|  |, )[0-9]{1,4}(?![0-9A-Za-z])", None),
}
CUES = {
    "email": r"(?i)e-?mail|contact|write|reach|address",
    "phone": r"(?i)phone|tel\b|tel[.:]|call|mobile|cell|fax|contact|whatsapp",
    "ip": r"(?i)\bip\b|ipv6|host|server|address|login|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay|account",
    "secret": r"(?i)token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|bearer|credential|private",
}
AGAINST = r"(?i)part|model|version|isbn|order|serial|sku|ratio|score|page|time|date|build|meet|look|commit|sha|md5|hash|digest|sum|uuid|etag|revision|public|file|path|link"
FEATURES = ("generator", "digits", "letters", "separators", "length", "distinct", "luhn", "hex", "ending", "cue", "against", "assigned", "before", "after")
#: Kinds that only the generators propose come after the base kinds.
ALL_KINDS = (*KINDS, "secret")
TRAINING_ROWS, PRECISION = 4800, 0.95


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has the check sum of a card number."""
    n = F.length(d)

    def value(i: Column) -> Column:
        x = F.substr(d, n - i + 1, F.lit(1)).cast("int")
        twice = x * 2
        return F.when(i % 2 == 1, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0).otherwise(False)


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(x)).between(12, 19) & luhn(digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def needed(pattern: str, needs: str | None, regex: bool = False) -> Column:
    """Whether the pattern need be tried on the text at all."""
    text = F.col("text_")
    return F.lit(True) if needs is None else text.rlike(needs) if regex else F.contains(text, F.lit(needs))


def parts(name: str) -> Column:
    """An array column in slices of about the square root of its size (an empty one is one slice).

    Work on each slice and the whole array, and on each element and its slice, grows with n ** 1.5 and not with n ** 2.
    """
    n = F.size(name)
    width = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / width).cast("int"))), lambda j: F.slice(name, j * width + 1, width))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each value, what merge has made of 0 and those before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda a, v: F.struct(merge(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def reach(spans_: Column) -> Column:
    return F.array_max(F.transform(spans_, lambda s: s["end"]))


def walked(name: str) -> Column:
    """Per slice of the matches and the pieces before them: its length, and its spans counted from its begin."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("spans"))

    return F.transform(parts(f"z_{name}"), lambda p: F.aggregate(p, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step))


def found(name: str) -> Column:
    """start, end, value of each match, in order."""
    begins = running(F.transform(f"w_{name}", lambda p: p["at"]), lambda a, b: a + b)
    moved = lambda p, by: F.transform(p["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))
    return F.flatten(F.zip_with(f"w_{name}", begins, moved))


def matched(df: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add s_<name>, the spans of each pattern in text_."""
    none = F.array().cast("array<string>")
    df = df.withColumns({f"m_{n}": F.when(need, F.regexp_extract_all("text_", F.lit(p), F.lit(0))).otherwise(none) for n, (p, need) in patterns.items()})
    df = df.withColumns({f"g_{n}": F.when(F.size(f"m_{n}") > 0, F.split("text_", p, -1)).otherwise(none) for n, (p, _) in patterns.items()})
    pair = lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"))
    df = df.withColumns({f"z_{n}": F.zip_with(f"m_{n}", F.slice(f"g_{n}", 1, F.size(f"m_{n}")), pair) for n in patterns})
    df = df.withColumns({f"w_{n}": walked(n) for n in patterns})
    df = df.withColumns({f"s_{n}": found(n) for n in patterns})
    return df.drop(*[f"{x}_{n}" for n in patterns for x in "mgzw"])


def features(name: str, kind: str, span: Column, near: Column) -> list[Column]:
    """near: a stretch of text around the span, and where it begins."""
    at = span["start"] - near["origin"]
    before = F.substr(near["text"], F.greatest(F.lit(1), at - 27), F.least(F.lit(28), at))
    after = F.substr(near["text"], span["end"] - near["origin"] + 1, F.lit(1))
    d = digits(span["value"])
    columns = [
        F.lit(list(GENERATORS).index(name)), F.length(d), F.length(F.regexp_replace(span["value"], "[^A-Za-z]", "")), F.length(F.regexp_replace(span["value"], "[A-Za-z0-9]", "")), F.length(span["value"]),
        F.size(F.array_distinct(F.split(span["value"], ""))), luhn(d), span["value"].rlike("^[0-9a-f]+$"), span["value"].rlike("(?i)(?:com|org|net|edu|info|io|de|uk|fr|es)$"),
        before.rlike(CUES[kind]), before.rlike(AGAINST), before.rlike("[=:]\\s?[\"']?$"), before.rlike("[A-Za-z0-9]$"), after.rlike("^[A-Za-z0-9]"),
    ]
    return [c.cast("double").alias(f) for c, f in zip(columns, FEATURES, strict=True)]


def candidates(df: DataFrame) -> DataFrame:
    """Add `candidates`: kind, start, end and the features of what the generators propose."""
    df = matched(df, {n: (p, needed(p, needs, True)) for n, (_, p, needs) in GENERATORS.items()})

    def proposed(name: str, kind: str) -> Column:
        def scored(p: Column) -> Column:
            origin = F.greatest(F.lit(0), F.get(p, F.lit(0))["start"] - 28)
            near = F.struct(origin.alias("origin"), F.substr(F.col("text_"), origin + 1, reach(p) + 1 - origin).alias("text"))
            return let(near, lambda x: F.transform(p, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *features(name, kind, s, x))))

        return F.flatten(F.transform(parts(f"s_{name}"), scored))

    return df.withColumn("candidates", F.concat(*[proposed(n, kind) for n, (kind, _, _) in GENERATORS.items()])).drop(*[f"s_{n}" for n in GENERATORS])


def training(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """text_, label: sentences with one value each; label, value and context are drawn from the row's number, each by itself."""

    def chance(salt: int, percent: Column | int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(100)) < percent

    def pick(salt: int, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    def number(salt: int, n: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")

    def group(salt: int) -> Column:
        return F.lpad(F.lower(F.hex(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(65536)))), 4, "0")

    def digest(salt: int, least: int, more: int) -> Column:
        return F.substr(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{salt}")), 256), F.lit(1), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(more)) + least).cast("int"))

    def mixed(salt: int, least: int, more: int) -> Column:
        return F.substr(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{salt}")), 256))), "+/=", "xY7"), F.lit(1), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(more)) + least).cast("int"))

    shape, good = F.col("id") % 6, chance(99, 50)
    likely = lambda salt, right, wrong: F.when(good, chance(salt, right)).otherwise(chance(salt, wrong))
    sep, odd = pick(1, ["-", " ", "."]), pick(2, [".", "/", "_"])
    fifteen = F.concat(number(3, 4), number(4, 4), number(5, 4), number(6, 3))
    check = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), lambda a, i: a + F.when(luhn(F.concat(fifteen, i.cast("string"))), i).otherwise(0))
    sixteen = F.concat(fifteen, F.when(likely(15, 92, 10), check).otherwise((check + 3) % 10).cast("string"))
    name, host = pick(7, ["ann", "j.doe", "info", "kim88", "look", "support", "it"]), pick(9, ["mail", "post-box", "uni", "example", "home", "page"])
    at = F.when(likely(16, 70, 15), pick(8, [" (at) ", "[at]", "(at)"])).otherwise(F.lit(" at "))
    dot = F.when(likely(17, 60, 15), pick(10, ["[dot]", " (dot) ", "."])).otherwise(F.lit(" dot "))
    dot = F.when(at == " at ", F.lit(" dot ")).otherwise(dot)
    file = F.concat(pick(18, ["build", "report", "img", "data", "main"]), sep, number(19, 8), pick(20, ["-final", "_v2", "-x86", "_eu"]), sep, pick(21, ["backup", "release", "thumb"]))
    loose = F.concat(pick(22, ["see_the", "none-of", "user_name", "my_value", "changeme"]), pick(23, ["-here", "_again", "", "_field"]))
    value = (
        F.when(shape == 0, F.concat(name, at, host, dot, F.when(likely(24, 90, 25), pick(11, ["com", "org", "net", "de"])).otherwise(pick(12, ["then", "of", "he", "was"]))))
        .when(shape == 1, F.concat(F.when(likely(25, 70, 12), F.concat(F.lit("("), number(13, 3), F.lit(") "))).otherwise(F.concat(number(13, 3), sep)), number(14, 3), sep, number(26, 4)))
        .when(shape == 2, F.concat_ws(":", *[F.when(likely(27, 97, 10), group(30 + k)).otherwise(number(40 + k, 2)) for k in range(8)]))
        .when(shape == 3, F.concat(*[x for k in range(4) for x in (F.substring(sixteen, 4 * k + 1, 4), odd)][:-1]))
        .when(shape == 4, F.when(likely(28, 95, 35), F.when(chance(29, 50), digest(50, 16, 40)).otherwise(mixed(51, 14, 28))).otherwise(F.when(chance(52, 50), loose).otherwise(number(53, 9))))
        .otherwise(F.when(likely(54, 97, 50), F.when(chance(55, 50), digest(56, 32, 9)).otherwise(mixed(57, 24, 16))).otherwise(file))
    )
    cue = (
        F.when(shape == 0, pick(60, ["my email is", "contact", "write to"])).when(shape == 1, pick(61, ["phone", "call me on", "tel."])).when(shape == 2, pick(62, ["server", "from ip", "host"]))
        .when(shape == 3, pick(63, ["card", "paid by visa", "credit card"])).otherwise(pick(64, ['token = "', "api_key: ", "the secret is ", "password=", "Authorization: Bearer ", 'auth_token="', "private key "]))
    )
    counter = F.when(shape < 4, pick(65, ["part", "model", "serial", "order", "score", "version", "the time", "look", "page"])).otherwise(pick(66, ["commit ", "sha256: ", "md5 ", "the hash ", "file ", "revision ", "public key ", "etag: ", "checksum = "]))
    named = F.when(shape == 4, pick(67, ['token = "', "key: ", "secret=", "password is ", "auth: "])).otherwise(F.lit(""))  # or nothing proposes it
    lead = F.when(likely(68, 85, 5), cue).when(likely(69, 5, 90), F.when(shape == 4, F.concat(counter, pick(70, ["key: ", "token ", "key = "]))).otherwise(counter)).otherwise(F.concat(pick(71, ["see ", "and then ", "it was "]), named))
    gap = F.when(lead.rlike("[ =\"]$"), F.lit("")).otherwise(F.lit(" "))
    return spark.range(rows).select("id", F.concat(F.lit("so "), lead, gap, value, F.lit(" and more")).alias("text_"), good.cast("int").alias("label"))


class Boosted:
    """Trees of depth 2 on logistic loss; each is (feature, cut, left, right) with (feature, cut, low, high) below."""

    def __init__(self, x: list[list[float]], y: list[int], rounds: int = 24, rate: float = 0.4) -> None:
        self.trees: list[tuple] = []
        f = [0.0] * len(y)
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-v)) for v in f]
            g, h = [b - a for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]

            def leaf(rows: list[int]) -> float:
                return rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)  # noqa: B023

            def best(rows: list[int]) -> tuple:
                gain, out = -1.0, None
                for j in range(len(FEATURES)):
                    order = sorted(rows, key=lambda i: x[i][j])  # noqa: B023
                    gs, hs, lg, lh = sum(g[i] for i in rows), sum(h[i] for i in rows), 0.0, 0.0  # noqa: B023
                    for a, b in zip(order, order[1:], strict=False):
                        lg, lh = lg + g[a], lh + h[a]  # noqa: B023
                        if x[a][j] != x[b][j] and (new := lg * lg / (lh + 1) + (gs - lg) ** 2 / (hs - lh + 1)) > gain + 1e-12:
                            gain, out = new, (j, (x[a][j] + x[b][j]) / 2)
                return out

            rows = list(range(len(y)))
            top = best(rows)
            if top is None:
                break
            sides = []
            for side in ([i for i in rows if x[i][top[0]] <= top[1]], [i for i in rows if x[i][top[0]] > top[1]]):
                below = best(side)
                if below is None:
                    sides.append(leaf(side))
                else:
                    sides.append((*below, leaf([i for i in side if x[i][below[0]] <= below[1]]), leaf([i for i in side if x[i][below[0]] > below[1]])))
            self.trees.append((*top, *sides))
            f = [v + self.value(self.trees[-1], r) for v, r in zip(f, x, strict=True)]

    def value(self, t, row: list[float]) -> float:
        return t if isinstance(t, float) else self.value(t[2] if row[t[0]] <= t[1] else t[3], row)

    def probability(self, row: list[float]) -> float:
        return 1 / (1 + math.exp(-sum(self.value(t, row) for t in self.trees)))

    def column(self, c: Column) -> Column:
        def of(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(c[FEATURES[t[0]]] <= t[1], of(t[2])).otherwise(of(t[3]))

        return F.lit(1.0) / (1 + F.exp(-sum((of(t) for t in self.trees[1:]), of(self.trees[0]))))


_trained: list[tuple[Boosted, dict[int, float]]] = []


def model(spark: SparkSession) -> tuple[Boosted, dict[int, float]]:
    """The trees, and the threshold of each generator; learned once in a driver."""
    if not _trained:
        # exploded here, as a filter on an exploded array would carry copies of its whole expression down the plan
        some = candidates(training(spark)).select("id", "label", "candidates").collect()
        rows = sorted((r.id, [c[f] for f in FEATURES], r.label) for r in some for c in r.candidates)
        x, y = [r[1] for r in rows], [r[2] for r in rows]
        fit, rest = [i for i, r in enumerate(rows) if r[0] // 6 % 2 == 0], [i for i, r in enumerate(rows) if r[0] // 6 % 2]
        trees = Boosted([x[i] for i in fit], [y[i] for i in fit])
        least = {}
        for j in range(len(GENERATORS)):
            scored = sorted(((trees.probability(x[i]), y[i]) for i in rest if x[i][0] == j), reverse=True)
            right, cut = 0, 1.1
            for n, (p, label) in enumerate(scored, 1):
                right += label
                if right >= PRECISION * n and (n == len(scored) or scored[n][0] < p):
                    cut = p
            least[j] = max(0.5, cut)
        _trained.append((trees, least))
    return _trained[0]


def spans(docs: DataFrame) -> DataFrame:
    """docs with `base` and `all_spans`: arrays of (start, k, end, kind), by start, then kind."""
    trees, least = model(docs.sparkSession)
    df = matched(docs.withColumn("text_", F.coalesce(F.col("text"), F.lit(""))), {k: (BASE[k], needed(BASE[k], NEEDS[k])) for k in KINDS})
    base = [F.transform(F.filter(f"s_{k}", (lambda k: lambda s: valid(k, s["value"]))(k)), (lambda i, k: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("k"), s["end"].alias("end"), F.lit(k).alias("kind")))(i, k)) for i, k in enumerate(KINDS)]
    df = df.withColumn("base", F.array_sort(F.concat(*base))).drop(*[f"s_{k}" for k in KINDS])
    df = candidates(df)
    number = {k: i for i, k in enumerate(ALL_KINDS)}

    def cut(c: Column) -> Column:
        return F.coalesce(*[F.when(c["generator"] == j, F.lit(v)) for j, v in least.items()])

    def overlap(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def kept(against: str, loses: Callable[[Column, Column], Column]) -> Column:
        """Those of `scored` that lose to no overlapping span of `against`, which is narrowed to the stretch of each slice first."""

        def of(p: Column) -> Column:
            stretch = F.struct(F.get(p, F.lit(0))["start"].alias("start"), reach(p).alias("end"))
            near = lambda r: F.filter(against, lambda b: overlap(b, r))
            return let(stretch, lambda r: let(near(r), lambda bs: F.filter(p, lambda c: ~F.exists(bs, lambda b: overlap(b, c) & loses(c, b)))))

        return F.when(F.size("scored") > 0, F.flatten(F.transform(parts("scored"), of)))

    def worse(c: Column, a: Column) -> Column:
        return (a["score"] > c["score"]) | ((a["score"] == c["score"]) & (F.struct(a["start"], a["k"], a["end"], a["g"]) < F.struct(c["start"], c["k"], c["end"], c["g"])))

    scored = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), F.coalesce(*[F.when(c["kind"] == k, F.lit(i)) for k, i in number.items()]).alias("k"), c["end"].alias("end"), c["kind"].alias("kind"), trees.column(c).alias("score"), cut(c).alias("cut"), c["generator"].alias("g")))
    df = df.withColumn("scored", F.when(F.size("candidates") > 0, scored)).drop("candidates")
    df = df.withColumn("scored", F.sort_array(F.filter("scored", lambda c: c["score"] >= c["cut"])))
    df = df.withColumn("scored", kept("base", lambda c, b: F.lit(True)))
    df = df.withColumn("scored", kept("scored", worse))
    plain = F.transform("scored", lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), c["kind"].alias("kind")))
    return df.withColumn("all_spans", F.when(F.size("scored") > 0, F.array_sort(F.concat("base", plain))).otherwise(F.col("base"))).drop("scored")


def written(column: str) -> Column:
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans, n_added, n_spans."""
    df = spans(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", (lambda k: lambda s: s["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("all_spans").alias("spans"), (F.size("all_spans") - F.size("base")).cast("long").alias("n_added"), F.size("all_spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span, or run of overlapping spans, replaced by the first one's kind in square brackets; other columns as they are."""
    df = spans(docs.select(F.struct(*docs.columns).alias("row"), "text"))  # no column of docs can clash with ours

    def rewritten(p: Column, at: Column) -> Column:
        """The text from where the spans before the slice end to where its own do."""

        def step(x: Column) -> Callable[[Column, Column], Column]:
            def of(a: Column, s: Column) -> Column:
                gap = F.substr(x["text"], a["at"] - x["origin"] + 1, s["start"] - a["at"])
                more = F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], more).otherwise(a["out"]).alias("out"))

            return of

        near = F.struct(at.alias("origin"), F.substr(F.col("text_"), at + 1, reach(p) - at).alias("text"))
        return let(near, lambda x: F.aggregate(p, F.struct(x["origin"].alias("at"), F.lit("").alias("out")), step(x), lambda a: a["out"]))

    df = df.withColumn("slices", parts("all_spans"))
    written_ = F.array_join(F.zip_with("slices", running(F.transform("slices", reach), F.greatest), rewritten), "")
    ended = F.concat(written_, F.substr(F.col("text_"), reach(F.col("all_spans")) + 1, F.length("text_")))
    text = F.when(F.size("all_spans") > 0, ended).otherwise(F.col("text"))
    return df.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
