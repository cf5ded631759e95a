"""Personal data by weak supervision, in DataFrame functions only.

1. Candidates: the contract's four patterns (email, ip, card, phone), their matches that fail a check,
   obfuscated addresses and national phone numbers.
2. Labelers vote on every candidate (yes, no, abstain): the pattern's own check, a gazetteer of
   top-level domains, issuer prefixes and dialling codes, words of the context, the characters beside
   the span, and its layout.
3. Expectation-maximisation over the counts of vote patterns (a table whose size is fixed by the
   number of kinds and labelers) estimates each labeler's reliability and each pattern's posterior.
4. A logistic span classifier is trained on the posteriors over discrete features, again from counts.
Spans that pass the contract's checks are always kept; the classifier adds others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract. Possessive groups and the look-behinds at the start
# change no match but keep the matcher linear and off the stack on very long runs.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Further candidates.
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63} ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z]{2,24}"
NATIONAL = r"(?<![0-9+.)-])(?<!\) )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"

DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "me", "de", "fr", "es", "uk", "eu", "us", "ca", "it", "nl", "ch", "at", "jp", "cn", "in", "br", "ru", "au", "mx")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NEAR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address|correo|courriel|adresse)\W",
    "ip": r"(?i)\b(?:ip|host|server|client|address|login|from|addr|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pan|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|dial|telefon|t.l.fono)\b",
}
FAR = r"(?i)(?:\b(?:version|release|build|order|isbn|token|serial|ref|sku|id|key|hash|section|chapter)\b|[=#\"'])[^A-Za-z0-9]{0,4}$"

FOLDED = 256  # matches of a text that are placed together
YES, NO, ABSTAIN = 1, 0, 2
LABELERS = 5


def _vote(yes: Column, no: Column | None = None) -> Column:
    no = ~yes if no is None else no
    return F.when(yes, YES).when(no, NO).otherwise(ABSTAIN)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int") * (1 + F.pmod(n - i, F.lit(2)))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return (n > 0) & (F.pmod(total, F.lit(10)) == 0)


def _matches(text: Column, pattern: str, guard: Column) -> Column:
    """Array of (start, end, m, before, after) of the leftmost non-overlapping matches, in code points."""
    found = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rest = F.when(guard, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["m"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["m"].alias("m"), F.right(pair["piece"], F.lit(32)).alias("before"), F.left(pair["next"], F.lit(8)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = lambda f, r: F.zip_with(f, F.sequence(F.lit(1), F.greatest(F.size(f), F.lit(1))), lambda m, i: F.struct(m.alias("m"), F.get(r, i - 1).alias("piece"), F.get(r, i).alias("next")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def block(state: Column, some: Column) -> Column:
        """Matches of a block behind those before: what an append copies is bounded by the block."""
        return F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("out")), step, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], s["out"]).alias("out")))

    def folded(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / FOLDED).cast("int")), lambda i: F.slice(p, i * FOLDED + 1, F.lit(FOLDED)))
        return F.aggregate(blocks, start, block, lambda s: s["out"])

    fold = lambda f, r: F.get(F.transform(F.array(pairs(f, r)), folded), F.lit(0))
    # a one-element transform names the two arrays, so that neither is worked out for every match
    both = F.transform(F.array(F.struct(found.alias("f"), rest.alias("r"))), lambda x: F.when(F.size(x["f"]) > 0, fold(x["f"], x["r"])).otherwise(none))
    return F.get(both, F.lit(0))


def _candidate(kind: str, s: Column, passes: Column) -> Column:
    m, number = s["m"], _digits(s["m"])
    n = F.length(number)
    if kind == "email":
        known = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(*DOMAINS)
        gazetteer, layout = _vote(known), _vote(~m.rlike(r"^\.|\.\.|\.@|-\.") & (F.length(m) <= 254))
    elif kind == "ip":
        gazetteer = _vote(m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-4])\."))
        layout = _vote(m.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$") & (F.length(m) >= 9))
    elif kind == "card":
        gazetteer = _vote(number.rlike(ISSUERS), number.rlike("^[019]"))
        layout = _vote(m.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$"))
    else:
        gazetteer = _vote(m.rlike(CODES), m.startswith("+"))
        layout = _vote(m.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}$"))
    context = _vote(s["before"].rlike(NEAR[kind]), s["before"].rlike(FAR))
    beside = _vote((s["before"].rlike(r"[\s(<\[:,;]$") | (s["before"] == "")) & (s["after"].rlike(r"^(?:[\s)>\],;:!?\"*#$%&]|\.(?:\s|$))") | (s["after"] == "")))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), passes.alias("base"),
        F.when(passes, YES).otherwise(NO).alias("v0"), gazetteer.alias("v1"), context.alias("v2"), beside.alias("v3"), layout.alias("v4"),
        F.least(n, F.lit(20)).alias("digits"), F.least(F.floor(F.length(m) / 4).cast("int"), F.lit(10)).alias("size"),
    )


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `found`: the candidate spans of the whole text with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = text.rlike("[0-9]")
    kept = docs.select(*keep, _matches(text, EMAIL, F.contains(text, F.lit("@"))).alias("_email"), _matches(text, IP, some).alias("_ip"), _matches(text, CARD, some).alias("_card"), _matches(text, PHONE, F.contains(text, F.lit("+"))).alias("_phone"), _matches(text, SPELT_EMAIL, text.rlike(r"[(\[{]at[)\]}]")).alias("_spelt"), _matches(text, NATIONAL, text.rlike(r"[0-9]{3}[ .-][0-9]{4}")).alias("_national"))
    yes = F.lit(True)
    lists = [
        F.transform("_email", lambda s: _candidate("email", s, yes)),
        F.transform("_ip", lambda s: _candidate("ip", s, s["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))),
        F.transform(F.filter("_card", lambda s: F.length(_digits(s["m"])).between(13, 19)), lambda s: _candidate("card", s, luhn(_digits(s["m"])))),
        F.transform(F.filter("_phone", lambda s: F.length(_digits(s["m"])).between(5, 20)), lambda s: _candidate("phone", s, F.length(_digits(s["m"])).between(9, 15))),
        F.transform("_spelt", lambda s: _candidate("email", s, F.lit(False))),
        F.transform("_national", lambda s: _candidate("phone", s, F.lit(False))),
    ]
    return kept.select(*keep, F.concat(*lists).alias("found"))


def em(kind: np.ndarray, votes: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every vote pattern, and P(vote | truth) of every labeler (labeler x truth x vote).

    Starts from the share of yes votes; pseudo-counts keep every probability inside (0, 1).
    """
    said = (votes != ABSTAIN).sum(axis=1)
    post = ((votes == YES).sum(axis=1) + 0.5) / (said + 1)
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([count * (1 - post), count * post])
        for j in range(votes.shape[1]):
            for truth in (0, 1):
                table[j, truth] = np.bincount(votes[:, j], weight[truth], 3) + (2.0 if truth else 1.0) * np.array([1, 1, 1])
                table[j, truth, truth] += 2.0  # labelers are better than chance
        table /= table.sum(axis=2, keepdims=True)
        yes = np.bincount(kind, weight[1], len(KINDS)) + 1
        prior = yes / (yes + np.bincount(kind, weight[0], len(KINDS)) + 1)
        log = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])])
        for j in range(votes.shape[1]):
            log += np.log(table[j][:, votes[:, j]])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return post, table


#: Discrete features of the span classifier and the number of values of each.
FEATURES = {"kind": len(KINDS), "v0": 3, "v1": 3, "v2": 3, "v3": 3, "v4": 3, "digits": 21, "size": 11}


def fit_classifier(features: np.ndarray, post: np.ndarray, count: np.ndarray, rounds: int = 400, rate: float = 0.5) -> list[list[float]]:
    """Logistic weights of every feature value by gradient ascent on the expected log likelihood."""
    sizes = list(FEATURES.values())
    at = np.cumsum([0, *sizes])
    w = np.zeros(at[-1])
    share = count / max(count.sum(), 1)
    for _ in range(rounds):
        z = sum(w[at[j] + features[:, j]] for j in range(len(sizes)))
        miss = share * (post - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        for j, n in enumerate(sizes):
            w[at[j] : at[j + 1]] += rate * np.bincount(features[:, j], miss, n)
        w *= 1 - 1e-5
    return [w[at[j] : at[j + 1]].round(9).tolist() for j in range(len(sizes))]


def learn(found: DataFrame) -> tuple[list[list[float]], np.ndarray]:
    """Classifier weights and labeler reliabilities from all candidates; only counts reach the driver."""
    counts = found.select(F.explode("found").alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in FEATURES]).count()
    rows = np.array([[int(x) for x in r] for r in counts.collect()], np.int64).reshape(-1, len(FEATURES) + 1)
    rows = rows[np.lexsort(rows.T[::-1])]
    if not len(rows):
        return [[0.0] * n for n in FEATURES.values()], np.full((LABELERS, 2, 3), 1 / 3)
    patterns, of = np.unique(rows[:, : 1 + LABELERS], axis=0, return_inverse=True)
    of = of.reshape(-1)
    post, table = em(patterns[:, 0], patterns[:, 1:], np.bincount(of, rows[:, -1]))
    return fit_classifier(rows[:, :-1], post[of], rows[:, -1].astype(float)), table


def spans(found: DataFrame, weights: list[list[float]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, `base` and `all`: sorted arrays of (kind, start, end) of the base and of all spans.

    A candidate is added when the classifier gives it 0.5 or more and it overlaps no base span and no
    earlier candidate of its kind.
    """
    logit = lambda c: sum(F.get(F.array(*[F.lit(float(x)) for x in w]), c[name].cast("int")) for w, name in zip(weights, FEATURES, strict=True))
    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda c: c["base"]), span))
    step = found.select(*keep, base.alias("base"), F.array_sort(F.transform(F.filter("found", lambda c: ~c["base"] & (logit(c) >= 0)), span)).alias("_more"))
    clash = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    apart = F.filter("_more", lambda c, i: ~F.exists("base", lambda b: clash(c, b)) & ((i == 0) | ~F.coalesce((F.get("_more", i - 1)["kind"] == c["kind"]) & clash(F.get("_more", i - 1), c), F.lit(False))))
    return step.select(*keep, "base", F.array_sort(F.concat("base", apart)).alias("all"))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, `base`, `all` for every document row; a null text is empty.

    The candidates are written to the shared checkpoint folder once, as they are read for learning
    and for the result. Repeated rows give repeated results; other columns are not carried.
    """
    found = cut_lineage(candidates(docs, keep))
    weights, _ = learn(found)
    return spans(found, weights, keep)


def digest(all_spans: Column | str) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows the text.

    Null texts stay null. Overlapping spans are replaced by the first one's kind.
    """
    rows = find(docs, tuple(docs.columns))
    name = lambda k: F.get(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k)
    ordered = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substr("text", (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), name(s["kind"]))
        put = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))
        return F.when(s["start"] >= state["at"], put).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out")))

    done = F.aggregate(ordered, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr("text", (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    text = F.when(F.col("text").isNull() | (F.size("all") == 0), F.col("text")).otherwise(done)
    out = rows.withColumn("text", text).drop("base", "all")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out
