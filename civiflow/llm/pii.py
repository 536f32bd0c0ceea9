"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers.
Looser patterns propose more candidates. Three labelers vote on each candidate:
the base pattern, a gazetteer, and the words before it. Expectation maximisation
over the counts of vote patterns (a table of bounded size, whatever the corpus)
estimates the labelers' reliabilities; a logistic classifier trained on its
posteriors, with the length class as a further feature, decides on the
candidates that are not base spans. Base spans always stay.

Null or empty text has no spans. Repeated rows are separate documents; other
columns are ignored; an empty table gives an empty result. Patterns have no
nested repetition, so very long runs neither recurse nor take quadratic time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiflow.plans.staging import stage

KINDS = ("email", "ip", "card", "phone")

# Private-use characters stand for a separator between two digits and for a dot
# between two label characters, so that runs become plain character classes.
SEP, DOT = "\ue000", "\ue001"
# Takes their place where a text has them itself; it is in no class of any pattern.
OTHER = "\ue002"

# Fixed values of the gazetteers and cues.
DOMAINS = r"\.(com|org|net|edu|gov|io|de|fr|es|uk|it|eu|info|example)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|address)\W*\w*\W*$",
    "ip": r"(?i)(\bip|address|host|server|from)\W*\w*\W*$",
    "card": r"(?i)(card|visa|credit|payment)\W*\w*\W*$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|contact)\W*\w*\W*$",
}

LOCAL = "A-Za-z0-9._%+" + DOT + "-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{SEP}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,64} ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z]{2,10}\b"
LOOSE_IP = r"(?<![0-9.\])])[0-9]{1,3}(?: ?[(\[]\.[)\]] ?| \. )[0-9]{1,3}(?: ?[(\[]\.[)\]] ?| \. |\.)[0-9]{1,3}(?: ?[(\[]\.[)\]] ?| \. |\.)[0-9]{1,3}(?![0-9.])"
LOOSE_CARD = r"(?<![0-9._/])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9._/])"
LOOSE_PHONE = r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9-])"


def found(name: str) -> Column:
    """Matches with 0-based start and end in code points and the text before each.

    ``m_name`` holds the matches and ``g_name`` the gaps of a split; they
    alternate, so positions are running sums.
    """
    return F.expr(
        f"""aggregate(
            arrays_zip(m_{name}, slice(g_{name}, 1, size(m_{name}))),
            named_struct('at', 0L, 'out', cast(array() as array<struct<start: bigint, stop: bigint, value: string, before: string>>)),
            (s, x) -> named_struct(
                'at', s.at + length(x.`1`) + length(x.m_{name}),
                'out', concat(s.out, array(named_struct('start', s.at + length(x.`1`), 'stop', s.at + length(x.`1`) + length(x.m_{name}), 'value', x.m_{name}, 'before', right(x.`1`, 24))))),
            s -> s.out)"""
    )


def vote(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def candidate(kind: str, strict: bool, gazetteer, spans: Column) -> Column:
    """Structs (start, kind, stop, base, gaz, cue, size) of the spans."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            s["stop"].alias("stop"),
            F.lit(int(strict)).alias("base"),
            vote(gazetteer(s["value"])).alias("gaz"),
            vote(s["before"].rlike(CUES[kind])).alias("cue"),
            F.when(s["stop"] - s["start"] < 12, 0).when(s["stop"] - s["start"] < 18, 1).otherwise(2).alias("size"),
        ),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans of each whole text."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    has = lambda pattern: F.col("t").rlike(pattern)
    plain = F.translate("t", SEP + DOT, OTHER * 2)
    marked = raw.withColumns(
        {
            "te": F.when(F.contains("t", F.lit("@")), F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)).otherwise(""),
            "ti": F.when(has(r"[0-9]\.[0-9]++\.[0-9]"), F.col("t")).otherwise(""),
            "tc": F.when(has("[0-9][ -]?[0-9]"), F.regexp_replace(plain, "(?<=[0-9])[ -](?=[0-9])", SEP)).otherwise(""),
            "tp": F.when(has(r"\+[0-9]"), F.col("t")).otherwise(""),
            "tl": F.when(has(r"[(\[](at|AT)[)\]]"), F.col("t")).otherwise(""),
            "tn": F.when(has("[0-9]{3}[ .-][0-9]{4}"), F.col("t")).otherwise(""),
            "td": F.when(has(r"[0-9] ?[(\[]\.[)\]]|[0-9] \. [0-9]"), F.col("t")).otherwise(""),
            "ts": F.when(has("[0-9]{4}[._/][0-9]{4}[._/]"), F.col("t")).otherwise(""),
        }
    ).drop("t")
    patterns = (("email", "te", EMAIL), ("ip", "ti", IP), ("card", "tc", CARD), ("phone", "tp", PHONE), ("mail2", "tl", LOOSE_EMAIL), ("phone2", "tn", LOOSE_PHONE), ("ip2", "td", LOOSE_IP), ("card2", "ts", LOOSE_CARD))
    cut = marked.select(
        "doc_id",
        *[F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias(f"m_{n}") for n, t, p in patterns],
        *[F.split(t, p).alias(f"g_{n}") for n, t, p in patterns],
    )
    spans = cut.select("doc_id", *[found(n).alias(n) for n, _, _ in patterns])
    octet = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    valid = {
        "email": F.col("email"),
        "ip": F.filter("ip", lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(octet))),
        "card": F.filter("card", lambda s: F.length(F.translate(s["value"], SEP, "")).between(14, 19) & F.call_function("luhn_check", F.translate(s["value"], SEP, ""))),
        "phone": F.filter("phone", lambda s: F.length(digits(s["value"])).between(10, 15)),
    }
    checks = {
        "email": lambda v: F.translate(v, DOT, ".").rlike("(?i)" + DOMAINS),
        "ip": lambda v: ~v.rlike(r"^(0|127|255)\."),
        "card": lambda v: F.translate(v, SEP, "").rlike(ISSUERS),
        "phone": lambda v: v.rlike(r"^\+(1|3[0-9]|4[0-9])|^\(?[2-9]"),
    }
    groups = [candidate(k, True, checks[k], valid[k]) for k in KINDS]
    groups.append(candidate("email", False, lambda v: v.rlike(r"(?i)(com|org|net|edu|example)$"), F.col("mail2")))
    groups.append(candidate("phone", False, checks["phone"], F.col("phone2")))
    octets = F.filter("ip2", lambda s: F.forall(F.regexp_extract_all(s["value"], F.lit("[0-9]+"), F.lit(0)), lambda p: p.rlike(octet)))
    groups.append(candidate("ip", False, lambda v: v.rlike(r"^(10|172|192|8)[^0-9]"), octets))
    numbers = F.filter("card2", lambda s: F.call_function("luhn_check", digits(s["value"])))
    groups.append(candidate("card", False, lambda v: digits(v).rlike(ISSUERS), numbers))
    return spans.select("doc_id", F.concat(*groups).alias("spans"))


VOTES = ("base", "gaz", "cue")


def posteriors(table: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]]]:
    """Dawid-Skene over counts of vote patterns: posterior of each, (hit, false alarm) rate of each labeler."""
    prior, rates = 0.7, [(0.8, 0.3)] * len(VOTES)
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _n in table:
            yes, no = prior, 1 - prior
            for v, (hit, false) in zip(votes, rates):
                yes *= hit if v else 1 - hit
                no *= false if v else 1 - false
            post[votes] = yes / (yes + no)
        # One count of each outcome is added, so no rate reaches 0 or 1.
        mass = sum(n * post[v] for v, n in table)
        rest = sum(n * (1 - post[v]) for v, n in table)
        prior = (mass + 1) / (mass + rest + 2)
        rates = [((sum(n * post[v] * v[j] for v, n in table) + 4) / (mass + 5), (sum(n * (1 - post[v]) * v[j] for v, n in table) + 1) / (rest + 5)) for j in range(len(VOTES))]
    return post, rates


def classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 500, rate: float = 0.5) -> list[float]:
    """Weights of a logistic model on (features, count, posterior)."""
    total = sum(n for _, n, _ in rows) or 1
    w = [0.0] * (len(rows[0][0]) + 1) if rows else []
    for _ in range(rounds):
        g = [0.0] * len(w)
        for x, n, y in rows:
            d = n / total * (sigmoid(w, x) - y)
            for j, v in enumerate((1, *x)):
                g[j] += d * v
        w = [a - rate * (b + 1e-4 * a) for a, b in zip(w, g)]
    return w


def sigmoid(w: list[float], x: tuple[int, ...]) -> float:
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, (1, *x)))))


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and spans: (start, kind, stop, base) in order, base spans and accepted candidates."""
    held = stage(candidates(docs), "candidates")
    one = held.select(F.explode("spans").alias("s")).select("s.kind", "s.base", "s.gaz", "s.cue", "s.size")
    # At most 4 x 2 x 2 x 2 x 3 rows.
    counts = one.groupBy("kind", *VOTES, "size").count().collect()
    accepted = set()
    for kind in range(len(KINDS)):
        rows = [((r["base"], r["gaz"], r["cue"]), r["size"], float(r["count"])) for r in counts if r["kind"] == kind]
        table: dict[tuple[int, ...], float] = {}
        for votes, _, n in rows:
            table[votes] = table.get(votes, 0) + n
        post, _ = posteriors(sorted(table.items()))
        features = lambda votes, size: (*votes, int(size == 1), int(size == 2))
        w = classifier([(features(v, s), n, post[v]) for v, s, n in sorted(rows)])
        accepted |= {f"{kind}{v[0]}{v[1]}{v[2]}{s}" for v, s, _ in rows if not v[0] and sigmoid(w, features(v, s)) >= least}
    name = lambda s: F.concat(*[s[c].cast("string") for c in ("kind", *VOTES, "size")])
    good = F.array(*[F.lit(a) for a in sorted(accepted)]).cast("array<string>")
    base = F.filter("spans", lambda s: s["base"] == 1)
    new = F.filter("spans", lambda s: (s["base"] == 0) & F.array_contains(good, name(s)))
    rows = held.select("doc_id", base.alias("b"), new.alias("n"))
    apart = F.filter("n", lambda s: ~F.exists("b", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    short = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["stop"], s["base"]))
    return rows.select("doc_id", F.array_sort(short(F.concat("b", apart))).alias("spans"))


def digests(spans: DataFrame) -> DataFrame:
    """Counts and digest of base spans, and all spans as text."""
    kinds = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"] == 1)
    count = lambda k: F.size(F.filter("spans", lambda s: (s["base"] == 1) & (s["kind"] == k))).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
