"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose spans. Three labelers vote on each: a strict pattern, a gazetteer and the context before the
span. The votes are summed by pattern of votes (a table whose size the labelers bound), and on these sums
expectation-maximisation estimates how reliable each labeler is for each kind and how likely each pattern
of votes is to be right. A logistic classifier over the span's features is fitted to these soft labels, as
well by sums, and decides about every span. Spans of the four base kinds that satisfy their definition always stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import stored, text_of
from lexiforge.llm.quality import let

#: The base kinds in the order in which results list them.
BASE = ("email", "ip", "card", "phone")
#: Gazetteers. Given names; country codes for phones and bank accounts; first digits of cards; endings of mail domains.
GIVEN = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Maria Jean Marie Pierre Claire Hans Klaus Sabine Petra Carlos Carmen Jose Ana Luis Sofia"
CALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 7 81 82 84 86 90 91 351 352 353 358 380 420"
IBAN = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE"
ISSUER = "4 5 34 35 36 37 38 6 2"
#: Beginnings of keys that services give out; area codes of large cities.
KEY = "AKIA ASIA AIza ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- sk_live_ sk-ant- sk-proj- rk_live_ SG. npm_ pypi- hf_ eyJ"
AREA = "202 206 210 212 213 214 215 303 305 310 312 313 314 323 404 408 412 415 416 503 504 512 514 602 604 612 617 619 702 713 714 718 770 773 801 808 813 818 832 847 858 901 904 909 917 919 925 949 972"
DOMAIN = "com org net edu gov io info biz example de fr es uk eu us ca"


Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Kind:
    """pattern: leftmost matches, not overlapping. guard: a cheap test that holds for every text with a match. valid, strict, gazetteer: tests of a match. context: a pattern on the characters before it."""

    name: str
    pattern: str
    guard: str
    valid: Test
    strict: Test
    gazetteer: Test
    context: str


def _always(m: Column) -> Column:
    return F.lit(True)


def _never(m: Column) -> Column:
    return F.lit(False)


def _like(pattern: str) -> Test:
    return lambda m: m.rlike(pattern)


def _starts(words: str, skip: str = "") -> Test:
    return _like(f"^{skip}(?:" + "|".join(words.split()) + ")")


def _compact(m: Column) -> Column:
    return F.translate(m, " -", "")


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


KINDS = (
    # Possessive runs and the look-behind spare retries within a run; the matches are those of the plain pattern:
    # either a run of local-part characters is followed by @ or no part of it is.
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", _always, _like(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@.*\.[A-Za-z]{2,}$"), _like(rf"\.(?:{'|'.join(DOMAIN.split())})$"), r"(?i)(?:mail|contact|write|reach)[^@]{0,20}$"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _octets, _like(r"^(?:(?:0|[1-9][0-9]{0,2})(?:[.]|$)){4}"), _like("^[^0]"), r"(?i)(?:\bip\b|address|host|server|from)[^0-9]{0,20}$"),
    # Shorter runs fail anyway, and asking for 16 digits here starts no match inside one.
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+", r"[0-9](?:[ -]?[0-9]){15}", lambda m: F.length(_compact(m)).between(16, 19) & F.call_function("luhn_check", _compact(m)), lambda m: F.length(_compact(m)) == 16, _starts(ISSUER), r"(?i)(?:card|visa|credit|pay)[^0-9]{0,20}$"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(F.translate(m, "+ ().-", "")).between(8, 15), _like(r"^[+][0-9]{1,3}[ .(-]"), _starts(CALLING, "[+]"), r"(?i)(?:phone|tel|call|mobile|fax)[^0-9]{0,20}$"),
    Kind("local_phone", r"(?<![0-9+().-])(?<![0-9)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", _always, _like(r"^(?:[(][2-9][0-9]{2}[)] ?|[2-9][0-9]{2}[.-])"), _starts(AREA, "[(]?"), r"(?i)(?:phone|tel|call|mobile|fax|contact)[^0-9]{0,20}$"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _always, lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$"), _never, r"(?i)(?:ssn|social security|tax id)[^0-9]{0,20}$"),
    Kind("bank_account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", _always, lambda m: F.length(F.translate(m, " ", "")).between(15, 34) & F.translate(m, " ", "").rlike("[0-9]{6}"), _starts(IBAN), r"(?i)(?:iban|account|bank|konto|compte|cuenta)[^0-9]{0,20}$"),
    # Any long run may be a secret: most are words, file names or rules. Votes tell them apart.
    Kind("secret", r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/.-]{20,}+={0,2}", r"[A-Za-z0-9_+/.-]{20}", _always, lambda m: m.rlike("^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pos]_[A-Za-z0-9]{36})$") | m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9_+/-]{20,}={0,2})$") & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 4) & m.rlike("[A-Za-z]"), _like("^(?:(?:" + "|".join(re.escape(k) for k in KEY.split()) + ")|[0-9a-f]+$|[0-9A-F]+$)"), r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(?:orization)?|bearer|credential)s?["']?\s*(?:[:=]|is)?\s*["']?$"""),
    Kind("name", rf"(?=[A-Z])(?<![A-Za-z])(?:{'|'.join(GIVEN.split())}) [A-Z][a-z]+(?![A-Za-z])", "[A-Z][a-z]{2,8} [A-Z][a-z]", _always, _like("^[A-Z][a-z]+ [A-Z][a-z]{2,}$"), _always, r"(?i)(?:name is|\bmrs?\.|\bms\.|\bdr\.|author:?|signed,?) ?$"),
)
LABELERS = ("strict", "gazetteer", "context")
FEATURES = (*LABELERS, "long", "digits", "open")


def spans_of(text: Column, kind: Kind, before: int = 24) -> Column:
    """array<struct<kind, start, end, base, strict, gazetteer, context, long, digits, open>>: the kind's valid spans, in code points.

    The text in front of each match is matched with it, so lengths add up to positions. The anchor to the last match keeps a
    search that fails in the tail from starting again at each of its characters.
    """
    gap, hit = (F.regexp_extract_all(text, F.lit(rf"\G(?s)(.*?)({kind.pattern})"), F.lit(i)) for i in (1, 2))
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string>>")

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(before)).alias("b")))).alias("out"))

    def placed(pairs: Column) -> Column:
        """Positions in blocks of 64 matches, so that a fold's growing array stays short."""
        blocks = F.when(F.size(pairs) == 0, F.array().cast("array<array<struct<g:string,m:string>>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / 64).cast("int")), lambda i: F.slice(pairs, i * 64 + 1, F.lit(64))))
        sizes = lambda all_: F.transform(all_, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["m"])))
        begins = lambda all_: F.aggregate(sizes(all_), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return let(blocks, lambda all_: F.flatten(F.zip_with(all_, begins(all_), lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"]))))

    raw = let(F.zip_with(gap, hit, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), placed)
    guarded = F.when(text.rlike(kind.guard), raw).otherwise(none)
    valid = F.filter(guarded, lambda x: let(x["m"], kind.valid))
    return F.transform(
        valid,
        lambda x: F.struct(
            F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), F.lit(kind.name in BASE).alias("base"),
            let(x["m"], kind.strict).cast("int").alias("strict"), let(x["m"], kind.gazetteer).cast("int").alias("gazetteer"), x["b"].rlike(kind.context).cast("int").alias("context"),
            (F.length(x["m"]) > 12).cast("int").alias("long"), x["m"].rlike("[0-9]{4}").cast("int").alias("digits"), ((x["b"] == "") | x["b"].rlike(r"[\s:=(]$")).cast("int").alias("open"),
        ),
    )


def label_model(sums: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """P(right) of each (kind, votes) by expectation-maximisation.

    sums holds (kind, votes, count). Labelers are taken as independent given the truth; each has, for each
    kind, a rate of votes on right and on wrong spans, with prior counts that state what is known before any
    data: a strict pattern or gazetteer votes for 9 in 10 right and 1 or 2 in 10 wrong spans, a context for
    3 and 1. Without data the priors decide; base kinds are held to be right more often than others.
    """
    prior = ((0.9, 0.2), (0.9, 0.2), (0.3, 0.05))
    out = {}
    for kind in {k for k, _, _ in sums}:
        own = [(v, n) for k, v, n in sums if k == kind]
        total = sum(n for _, n in own)
        weight = max(20.0, 0.05 * total)  # of the priors, so that a labeler that never varies can't take over
        base = 0.8 if kind in BASE else 0.3
        share, rates = base, [list(p) for p in prior]
        for _ in range(rounds):
            right = {}
            for v, _ in own:
                a, b = math.log(share), math.log(1 - share)
                for vote, (r, w) in zip(v, rates, strict=True):
                    a += math.log(r if vote else 1 - r)
                    b += math.log(w if vote else 1 - w)
                right[v] = 1 / (1 + math.exp(b - a))
            good = sum(n * right[v] for v, n in own)
            share = (good + weight * base) / (total + weight)
            for i, (r, w) in enumerate(prior):
                yes = sum(n * right[v] for v, n in own if v[i])
                no = sum(n * (1 - right[v]) for v, n in own if v[i])
                rates[i] = [min(0.99, (yes + weight * r) / (good + weight)), max(0.01, (no + weight * w) / (total - good + weight))]
        out |= {(kind, v): p for v, p in right.items()}
    return out


def classifier(sums: list[tuple[str, tuple[int, ...], int]], soft: dict[tuple[str, tuple[int, ...]], float], steps: int = 200) -> tuple[dict[str, float], list[float]]:
    """Bias of each kind and weights of FEATURES: logistic regression on sums of (kind, features), with soft labels, by gradient steps.

    Each row weighs its count over its kind's total, so a frequent kind doesn't drown others.
    """
    totals: dict[str, int] = {}
    for k, _, n in sums:
        totals[k] = totals.get(k, 0) + n
    bias, weights = {k.name: 0.0 for k in KINDS}, [0.0] * len(FEATURES)
    for _ in range(steps):
        by_kind, by_feature = dict.fromkeys(bias, 0.0), [0.0] * len(weights)
        for k, x, n in sums:
            p = 1 / (1 + math.exp(-(bias[k] + sum(w for w, f in zip(weights, x, strict=True) if f))))
            off = (soft[k, x[: len(LABELERS)]] - p) * n / totals[k]
            by_kind[k] += off
            for i, f in enumerate(x):
                by_feature[i] += f * off
        bias = {k: b + 2 * g for k, (b, g) in zip(bias, zip(bias.values(), by_kind.values(), strict=True), strict=True)}
        weights = [w + g - 0.001 * w for w, g in zip(weights, by_feature, strict=True)]
    return bias, weights


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, the text if asked for, and spans for each row: array<struct<kind, start, end, base>> by kind as in KINDS, then start.

    Null texts count as empty and have no spans, an empty table gives no rows, repeated rows come as often as
    they are, other columns are not looked at. A further span that overlaps a base span is dropped, and so is one that
    overlaps another of an earlier kind.

    Plan: one pass over the texts proposes spans and stores them, narrow, with their votes; votes and features
    are summed (at most kinds * 2 ** features rows, whatever the corpus); the last pass reads the stored spans.
    No shuffle but for these sums.
    """
    text = text_of(text_col)
    own = [text.alias(text_col)] if with_text else []
    found = stored(df.select(F.col(id_col), *own, F.concat(*[spans_of(text, k) for k in KINDS]).alias("spans")), "pii")
    flat = found.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{f}" for f in FEATURES]).count()
    sums = sorted((r[0], tuple(r[1:-1]), r[-1]) for r in flat.collect())
    votes: dict[tuple, int] = {}
    for k, x, n in sums:
        votes[k, x[: len(LABELERS)]] = votes.get((k, x[: len(LABELERS)]), 0) + n
    bias, weights = classifier(sums, label_model([(k, v, n) for (k, v), n in sorted(votes.items())]))
    kinds = F.create_map(*[x for k, b in bias.items() for x in (F.lit(k), F.lit(b))])

    def score(s: Column) -> Column:
        total = F.element_at(kinds, s["kind"])
        for f, w in zip(FEATURES, weights, strict=True):
            total = total + s[f] * F.lit(w)
        return total

    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    rank = lambda s: F.array_position(F.array(*[F.lit(k.name) for k in KINDS]), s["kind"])

    def chosen(spans: Column) -> Column:
        yes = F.filter(spans, lambda s: s["base"] | (score(s) > 0))
        more = lambda all_: F.filter(all_, lambda s: s["base"] | ~F.exists(all_, lambda o: meets(s, o) & (rank(o) < rank(s))))
        return F.when(F.exists(yes, lambda s: ~s["base"]), let(yes, more)).otherwise(yes)

    final = F.transform(chosen(F.col("spans")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select(*[c for c in found.columns if c != "spans"], final.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, of further spans and of all, and spans as text: kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    spans = F.col("spans")
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter(spans, of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.array_join(F.transform(F.filter(spans, lambda s: s["base"]), one), ",")
    counts += [F.size(F.filter(spans, lambda s: ~s["base"])).cast("long").alias("n_further"), F.size(spans).cast("long").alias("n_spans")]
    return found.select(*[c for c in found.columns if c != "spans"], *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(spans, one), ",").alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text with each span replaced by its kind in angle brackets (of overlapping spans, the first)."""
    spans = personal_data(df, id_col, text_col, with_text=True)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(a)

    done = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return spans.select(F.col(id_col), done.alias(text_col))
