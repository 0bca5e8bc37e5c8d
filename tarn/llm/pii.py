r"""Personal data by weak supervision, in DataFrame expressions only.

Base spans come from patterns with checks (email, ip, card, phone) and always stay. The method adds spans of three more
kinds: ``secret`` (a run of 16 or more letters and digits, with a digit), ``number`` (9 or more digits in groups) and
``iban`` (two letters, two digits and 11 to 30 more characters). Each candidate gets votes (yes, no, abstain) of
labelers: two shape labelers (regex and checksums), a gazetteer and a context labeler of what stands around it. The
gazetteer looks up the words before a candidate among known names of accounts, secrets and papers in four languages and
among harmless ones, and the country of an iban and the calling code of a number among the known ones.
Expectation-maximisation over the counts of vote patterns of the whole corpus estimates each labeler's reliability and
each pattern's probability; these soft labels train a naive Bayes classifier of the candidate's features, which decides.
Patterns and features are small integers, so the tables that the estimation works on have at most PATTERNS and FEATURES
rows, whatever the corpus. Candidates that overlap a base span are dropped, found by binary search among the spans.

Places are code points: a text is split at a pattern's matches, and the lengths of gaps and matches are summed up, in
runs of RUN matches so that the work stays in proportion to a text with very many matches. Patterns have no
quantifier that backtracks or recurses over long runs, and match what the plain patterns match: a run's inner starts
are skipped (lookbehind), unless the last match ended there (\G).

Defined cases: null and empty texts have no spans; repeated doc_ids are rows of their own; without candidates nothing
is added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "secret", "number", "iban")
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+",
    "number": r"(?<![0-9+])\(?[0-9](?:[)\x20./-]{0,2}+[0-9]){8,}+",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9_])",
}
RUN, EM_STEPS, ACCEPT = 256, 40, 0.5
LABELERS = ("shape", "strict", "gazetteer", "context")
PATTERNS, FEATURES = 3 ** len(LABELERS), 1024
#: Gazetteer: words that name a secret, a paper or an account, and words that name something harmless
CUES = (
    "token", "secret", "password", "passwd", "passwort", "contrasena", "key", "apikey", "api", "auth", "bearer", "credential", "pin", "login",
    "phone", "tel", "telephone", "telefon", "telefono", "mobile", "handy", "movil", "portable", "call", "fax", "whatsapp",
    "card", "visa", "mastercard", "amex", "tarjeta", "carte", "karte", "kreditkarte", "iban", "bic", "account", "konto", "kontonummer", "compte", "cuenta",
    "ssn", "passport", "pasaporte", "passeport", "reisepass", "ausweis", "dni", "nif", "license", "insurance", "patient", "customer", "kundennummer",
)
HARMLESS = ("version", "licence", "isbn", "issn", "page", "section", "chapter", "year", "http", "https", "sha", "sha1", "sha256", "md5", "commit", "build", "revision", "checksum", "hash", "uuid", "lines", "doi", "figure", "table")
#: Gazetteer: countries whose accounts have an iban
COUNTRIES = (
    "AD", "AE", "AL", "AT", "AZ", "BA", "BE", "BG", "BH", "BR", "CH", "CR", "CY", "CZ", "DE", "DK", "DO", "EE", "ES", "FI", "FO", "FR", "GB", "GE", "GI", "GL", "GR", "GT", "HR", "HU", "IE", "IL", "IS", "IT", "JO", "KW", "KZ", "LB", "LI",
    "LT", "LU", "LV", "MC", "MD", "ME", "MK", "MR", "MT", "MU", "NL", "NO", "PK", "PL", "PS", "PT", "QA", "RO", "RS", "SA", "SE", "SI", "SK", "SM", "TN", "TR", "UA", "VG", "XK",
)
#: Gazetteer: calling codes
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421", "971", "972")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(i)).otherwise(value(i)))
    return total % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an iban's check digits hold."""
    c = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.left(c, F.lit(4)))
    value = lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    step = lambda acc, ch: (acc * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0), step) == 1


def overlaps(spans: Column, c: Column) -> Column:
    """Whether a span of an array (in order, apart from each other) meets c: binary search for the first that ends beyond c's start."""
    n = F.size(spans)
    steps = F.sequence(F.lit(0), F.ceil(F.log2((n + 1).cast("double"))).cast("int"))

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        beyond = F.get(spans, middle)["end"] > c["start"]
        open_ = state["lo"] < state["hi"]
        return F.struct(F.when(open_ & ~beyond, middle + 1).otherwise(state["lo"]).alias("lo"), F.when(open_ & beyond, middle).otherwise(state["hi"]).alias("hi"))

    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda x: x["lo"])
    return F.when(n == 0, False).otherwise(F.coalesce(F.get(spans, at)["start"] < c["end"], F.lit(False)))


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        d = F.regexp_replace(match, r"[\x20-]", "")
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def hint(kind: str) -> Column:
    """A cheap test that a text with a match passes."""
    text = F.col("text")
    return {"email": text.contains("@"), "phone": text.contains("+"), "iban": text.rlike("[A-Z]{2}[0-9]{2}")}.get(kind, text.rlike("[0-9]"))


def _sums(lengths: Column, start: Column) -> Column:
    """Running sums of an array of at most RUN numbers, begun at start."""
    empty = F.array().cast("array<int>")
    return F.aggregate(lengths, F.struct(start.alias("s"), empty.alias("a")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"])


def with_matches(docs: DataFrame, kind: str) -> DataFrame:
    """Adds m_kind: array of (start, end, match) of a pattern's leftmost matches."""
    p, g, m, n, r, o = (f"_{c}_{kind}" for c in "pgmnro")
    none = F.array().cast("array<string>")
    x = docs.withColumns({g: F.when(hint(kind), F.split("text", PATTERN[kind], -1)).otherwise(none), m: F.when(hint(kind), F.regexp_extract_all("text", F.lit(PATTERN[kind]), F.lit(0))).otherwise(none)})
    x = x.withColumn(n, F.size(m))
    # lengths from one match's start to the next one's: the match before, then the gap
    steps = F.transform(F.col(m), lambda _, i: F.length(F.get(F.col(g), i)) + F.when(i > 0, F.length(F.get(F.col(m), i - 1))).otherwise(0))
    x = x.withColumn(p, steps)
    runs = F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / RUN).cast("int")), lambda c: F.slice(F.col(p), c * RUN + 1, F.lit(RUN)))).otherwise(F.array().cast("array<array<int>>"))
    x = x.withColumn(r, runs)
    totals = F.transform(F.col(r), lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v))
    x = x.withColumn(o, F.concat(F.array(F.lit(0)), _sums(totals, F.lit(0))))
    starts = F.flatten(F.transform(F.col(r), lambda a, i: _sums(a, F.get(F.col(o), i))))
    spans = F.transform(F.arrays_zip(starts.alias("s"), F.col(m).alias("m")), lambda z: F.struct(z["s"].alias("start"), (z["s"] + F.length(z["m"])).alias("end"), z["m"].alias("match")))
    return x.withColumn(f"m_{kind}", spans).drop(p, g, m, n, r, o)


def _vote(yes: Column, no: Column) -> Column:
    """1 for, 2 against, 0 abstains."""
    return F.when(yes, 1).when(no, 2).otherwise(0)


def candidate(kind: str, text: Column, c: Column) -> Column:
    """A candidate as (start, end, kind, votes, features)."""
    match, before = c["match"], F.substring(text, F.greatest(c["start"] - 24, F.lit(0)) + 1, F.least(c["start"], F.lit(24)))
    after = F.substring(text, c["end"] + 1, F.lit(2))
    length, digits = F.length(match), F.length(_digits(match))
    words = F.regexp_extract_all(F.lower(before), F.lit(r"\p{L}+"), F.lit(0))
    near = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))
    cue = F.arrays_overlap(near, F.array(*[F.lit(w) for w in CUES]))
    harmless = F.arrays_overlap(near, F.array(*[F.lit(w) for w in HARMLESS]))
    if kind == "secret":
        shape = _vote(match.rlike("^(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)$") | (length >= 32), match.rlike("^(.)\\1+$") | (digits == length))
        strict = _vote(digits.between(length * 0.2, length * 0.85) & match.rlike("[A-Za-z]"), digits < length * 0.1)
        known = F.lit(False)
    elif kind == "iban":
        shape = _vote(F.length(F.regexp_replace(match, " ", "")).between(15, 34), digits < length * 0.3)
        strict = _vote(mod97(match), ~mod97(match))
        known = F.left(match, F.lit(2)).isin(*COUNTRIES)
    else:
        shape = _vote(digits.between(12, 19) | match.rlike(r"^\(?[0-9]{3}[) .-]{1,2}+[0-9]{3}[ .-][0-9]{4}$"), match.rlike(r"^[0-9]{1,4}(?:[./][0-9]{1,4})++$"))
        strict = _vote(F.when(digits.between(12, 19), luhn(_digits(match))).otherwise(False), digits > 19)
        code = F.regexp_extract(match, r"^00([0-9]{1,3})[ -]", 1)
        known = code.isin(*CALLING)
    gazetteer = _vote(cue | known, harmless)
    context = _vote(before.rlike("[=:]\\s*[\"']?$") | after.rlike("^[\"']"), before.rlike("[A-Za-z0-9]$") & after.rlike("^[A-Za-z0-9]"))
    votes = ((shape * 3 + strict) * 3 + gazetteer) * 3 + context
    size = F.least(F.floor(F.log2(length.cast("double"))), F.lit(7)).cast("int")
    share = F.least(F.floor(digits * 4 / length), F.lit(3)).cast("int")
    features = ((F.lit(KINDS.index(kind) - 4) * 8 + size) * 4 + share) * 8 + (cue | known).cast("int") * 4 + before.rlike("[=:]\\s*[\"']?$").cast("int") * 2 + after.rlike("^[\"']").cast("int")
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), votes.cast("int").alias("votes"), features.cast("int").alias("features"))


def spans_and_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base: array of (start, kind, end), candidates: array of (start, end, kind, votes, features) off the base spans."""
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        x = with_matches(x, kind)


    def passing(kind: str) -> Column:
        return F.filter(f"m_{kind}", lambda c: valid(kind, c["match"]))

    x = x.withColumns({f"m_{k}": passing(k) for k in KINDS[:4]} | {"_sure": F.filter("m_iban", lambda c: mod97(c["match"]))})

    def checked(kind: str) -> Column:
        return F.transform(f"m_{kind}", lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end")))

    def offered(kind: str) -> Column:
        met = lambda c: [overlaps(F.col(f"m_{k}"), c) for k in KINDS[:4]]
        off = F.filter(f"m_{kind}", lambda c: ~functools.reduce(operator.or_, met(c)))
        if kind != "iban":
            off = F.filter(off, lambda c: ~overlaps(F.col("_sure"), c))
        return F.transform(off, lambda c: candidate(kind, F.col("text"), c))

    base = F.concat(*[checked(k) for k in KINDS[:4]])
    x = x.withColumn("base", F.array_sort(base))
    more = F.concat(*[offered(k) for k in KINDS[4:]])
    return x.select("doc_id", "base", more.alias("candidates"))


def _yes(votes: Column, i: int) -> Column:
    return F.floor(votes / 3 ** (len(LABELERS) - 1 - i)).cast("int") % 3


def reliabilities(patterns: DataFrame, steps: int = EM_STEPS) -> DataFrame:
    """One row: the prior, and for each labeler the chance of a yes among its votes on true and on false candidates.

    patterns: (votes, n), at most PATTERNS rows.
    """
    votes = [f"v{i}" for i in range(len(LABELERS))]
    rows = patterns.select(F.col("n").cast("double").alias("n"), *[_yes(F.col("votes"), i).alias(v) for i, v in enumerate(votes)])
    one = rows.agg(F.collect_list(F.struct("n", *votes)).alias("p"))
    k = range(len(LABELERS))
    start = F.struct(F.lit(0.5).alias("pi"), F.array(*[F.lit(0.8)] * len(k)).alias("a"), F.array(*[F.lit(0.2)] * len(k)).alias("b"))

    def soft(state: Column, row: Column) -> Column:
        yes, no = state["pi"], 1 - state["pi"]
        for i, v in enumerate(votes):
            a, b = state["a"][i], state["b"][i]
            yes = yes * F.when(row[v] == 1, a).when(row[v] == 2, 1 - a).otherwise(1.0)
            no = no * F.when(row[v] == 1, b).when(row[v] == 2, 1 - b).otherwise(1.0)
        return yes / (yes + no)

    def total(rs: Column, of) -> Column:
        return F.aggregate(rs, F.lit(0.0), lambda s, x: s + of(x))

    def step(state: Column, _: Column) -> Column:
        rs = F.transform(F.col("p"), lambda row: F.struct(row.alias("row"), soft(state, row).alias("r")))
        def new(x: Column) -> Column:
            rate = lambda i, w: (total(x, lambda y: F.when(y["row"][votes[i]] == 1, w(y)).otherwise(0.0)) + 1) / (total(x, lambda y: F.when(y["row"][votes[i]] > 0, w(y)).otherwise(0.0)) + 2)
            true, false = (lambda y: y["row"]["n"] * y["r"]), (lambda y: y["row"]["n"] * (1 - y["r"]))
            pi = (total(x, true) + 1) / (total(x, lambda y: y["row"]["n"]) + 2)
            return F.struct(pi.alias("pi"), F.array(*[rate(i, true) for i in k]).alias("a"), F.array(*[rate(i, false) for i in k]).alias("b"))
        return F.transform(F.array(rs), new)[0]

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("em")).select("em.*")


def accepted_features(found: DataFrame, steps: int = EM_STEPS, accept: float = ACCEPT) -> list[int]:
    """Feature codes (at most FEATURES) that the span classifier takes, trained on the estimated labels."""
    counts = materialize(found.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").agg(F.count(F.lit(1)).alias("n")), "votes")
    if not counts.take(1):
        return []
    em = reliabilities(counts.groupBy("votes").agg(F.sum("n").alias("n")), steps)
    yes, no = F.col("pi"), 1 - F.col("pi")
    for i in range(len(LABELERS)):
        v = _yes(F.col("votes"), i)
        a, b = F.col("a")[i], F.col("b")[i]
        yes, no = yes * F.when(v == 1, a).when(v == 2, 1 - a).otherwise(1.0), no * F.when(v == 1, b).when(v == 2, 1 - b).otherwise(1.0)
    soft = counts.join(F.broadcast(em), F.lit(True)).select("features", (F.col("n") * yes / (yes + no)).alias("t"), (F.col("n") * no / (yes + no)).alias("f"))
    code = F.col("features")
    parts = F.array(*[F.struct(F.lit(j).alias("slot"), F.floor(code / div).cast("int") % mod) for j, (div, mod) in enumerate(((256, 4), (32, 8), (8, 4), (4, 2), (2, 2), (1, 2)))])
    parts = F.transform(parts, lambda s: F.struct(s["slot"].alias("slot"), s["col2"].alias("value")))
    slots = soft.select("t", "f", F.explode(parts).alias("s")).groupBy("s.slot", "s.value").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    totals = soft.agg(F.sum("t").alias("tt"), F.sum("f").alias("ff"))
    odds = slots.join(F.broadcast(totals), F.lit(True)).select("slot", "value", F.log((F.col("t") + 1) / (F.col("tt") + 8) * (F.col("ff") + 8) / (F.col("f") + 1)).alias("odds"))
    seen = counts.select("features").distinct().select("features", F.explode(parts).alias("s")).select("features", "s.*")
    scored = seen.join(odds, ["slot", "value"]).groupBy("features").agg(F.sum("odds").alias("odds")).join(F.broadcast(totals), F.lit(True))
    logit = F.col("odds") + F.log((F.col("tt") + 1) / (F.col("ff") + 1))
    return sorted(r["features"] for r in scored.where(1 / (1 + F.exp(-logit)) >= accept).select("features").collect())


def find_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all of them)."""
    found = materialize(spans_and_candidates(docs), "spans")
    taken = accepted_features(found, accept=accept)
    more = F.filter("candidates", lambda c: c["features"].isin(taken)) if taken else F.slice("candidates", 1, 0)
    more = F.transform(more, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    name = lambda s: F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    number = lambda i: F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", more))).alias("spans"), (F.size("base") + F.size(more)).cast("long").alias("n_spans"))
