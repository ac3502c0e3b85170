"""Secret scans in DataFrame functions: three base patterns, and character Markov models.

A model of random strings and one of ordinary identifiers, each a table of character pairs
trained from labelled samples, are compared by log-likelihood ratio. The ratios are whole
thousandths, so that sums are the same in any order and engine. What the models see is the text
with its base spans blanked: the runs of letters in it, and in runs that are not random as a
whole their parts between separators.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run too short to judge is no candidate; a ratio per pair, in thousandths, at or under the
#: least is no secret: of samples set aside it leaves 1 in 100 random strings and takes no identifier.
SHORTEST, LEAST = 20, 500
RUN, PART = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}", rf"[A-Za-z0-9+]{{{SHORTEST},}}"
#: Elements of an array that are scanned in one go, and code points of a text that are rewritten so.
STEP, PIECE = 256, 4096
KINDS = ["assign", "access", "hex", "markov"]

_WORDS = (
    "account action active address admin after agent alert alias amount answer archive array article assert author balance "
    "banner base batch before binary block body border branch browser bucket buffer builder button cache call cancel capture "
    "category channel char check child class client clone close cluster code collection column command comment commit common "
    "compare complete component compute config connect console constant container content context control convert cookie copy "
    "count create current cursor custom data database date debug decode default delete deploy derive describe detail device "
    "dialog digest directory dispatch display document domain download driver duration element email empty enable encode engine "
    "entity entry error event example exception execute expire export expression extend factory feature field file filter final "
    "find first flag folder footer format frame from function gateway generate get global graph group handle handler hash header "
    "height helper history host identity image import include index info initial inner input insert instance integer interface "
    "internal invalid item iterator join json kernel key keyword label language last latency layer layout length level library "
    "license limit line link list listener load local location lock logger login loop machine main manager map mark match matrix "
    "maximum member memory menu merge message metadata method metric middle minimum mode model module monitor mount move name "
    "native network next node notification null number object offset open operation option order origin output owner package page "
    "panel parameter parent parse partition password path pattern payment pending permission person picture pipeline plugin point "
    "policy pool port position prefix previous price primary print priority private process product profile program project "
    "promise property protocol provider proxy public publish query queue random range rate read receive record redirect reduce "
    "reference refresh region register release remote remove render repeat replace report request reset resolve resource response "
    "result retry return role root route rule runtime sample save scale schedule schema scope screen script search second section "
    "security segment select selector send sequence serial server service session setting shape share shift signal simple single "
    "size slice snapshot socket sort source space split stack stage standard start state static status storage store stream string "
    "structure style submit subscribe suffix summary support switch symbol sync system table target task template test text theme "
    "thread threshold time timeout title toggle token tool topic total trace track transaction transform translate tree trigger "
    "type undefined union unique update upload user util valid value variable vector verify version view virtual visible wait "
    "warning watch weight width window word worker wrapper write zone the and that which with from have this they will would there "
    "their what about other into could than been only over also after most these where through because between should under while "
    "und nicht werden eine einen wurde haben schreiben sprechen verstehen ordnung freiheit entwicklung einstellung verbindung les "
    "des est que pour dans avec être entre toujours maintenant quelque fonction bibliotheque los las para como esta pero cuando "
    "siempre desarrollo configuracion informacion aplicacion seguridad"
).split()


def labelled_samples(words: list[str] = _WORDS, name: str = "sample") -> tuple[list[str], list[str]]:
    """Random strings, of three alphabets, and ordinary identifiers of `words` in the usual spellings."""
    stream = b"".join(hashlib.sha512(f"{name} {i}".encode()).digest() for i in range(400))
    random, at = [], 0
    for n, letters in [(160, LETTERS[:62]), (120, LETTERS), (80, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")]:
        for _ in range(n):
            random.append("".join(letters[b % len(letters)] for b in stream[at : at + 40]))
            at += 40
    ordinary = []
    for i, a in enumerate(words):
        b, c = words[(i * 7 + 3) % len(words)], words[(i * 13 + 5) % len(words)]
        ordinary += [a + b + c, f"{a}_{b}_{c}", f"{a}-{b}-{c}", a + b.title() + c.title(), a.title() + b.title(), f"{a}/{b}/{c}", f"{a}_{b}_{i % 10}", f"{a.upper()}_{b.upper()}", a.upper() + b.upper()]
    return random, ordinary


def ratios(random: list[str], ordinary: list[str]) -> list[int]:
    """Log-likelihood ratios, in thousandths, of each pair of letters, row by row: add-half
    counts of the second letter given the first."""
    n = len(LETTERS)

    def model(strings):
        counts = [[0.5] * n for _ in range(n)]
        for s in strings:
            codes = [LETTERS.find(c) for c in s]
            for a, b in zip(codes, codes[1:], strict=False):
                if a >= 0 and b >= 0:
                    counts[a][b] += 1
        return [[math.log(x / sum(row)) for x in row] for row in counts]

    p, q = model(random), model(ordinary)
    return [round(1000 * (p[a][b] - q[a][b])) for a in range(n) for b in range(n)]


TABLE = ratios(*labelled_samples())


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _is_random(run: Column) -> Column:
    learned = F.split(F.lit(",".join(map(str, TABLE))), ",").cast("array<long>")
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(LETTERS), c))
    pairs = F.zip_with(F.slice(codes, 1, F.length(run) - 1), F.slice(codes, 2, F.length(run) - 1), lambda a, b: F.element_at(learned, (a - 1) * len(LETTERS) + b))
    return _sum(pairs) > LEAST * (F.length(run) - 1)


def _scanned(items: Column, kind: str, out: str, step) -> Column:
    """What `step` puts out for each item in order, nulls left out, as it passes on a state of type
    `kind` that begins at zero. Appending copies an array, so items are scanned STEP at a time."""
    inner, outer = f"struct<at:{kind},out:array<{out}>>", f"struct<at:{kind},out:array<array<{out}>>>"
    start = lambda at, of: F.struct(at.alias("at"), F.array().alias("out")).cast(of)

    def one(acc, x):
        at, made = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(made.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], made)).alias("out")).cast(inner)

    def part(acc, k):
        joined = lambda own: F.struct(own["at"].alias("at"), F.array_append(acc["out"], own["out"]).alias("out")).cast(outer)
        return F.aggregate(F.slice(items, k * STEP + 1, STEP), start(acc["at"], inner), one, joined)

    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")))
    return F.aggregate(parts, start(F.lit(0), outer), part, lambda acc: F.flatten(acc["out"]))


_SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _spans(text: Column, pattern: str, kind: int, good) -> Column:
    """The matches that are good, with places in code points. The gaps between the matches and
    the matches, read by turns, add up to the places; `good` tells it of each match."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), good(hits).alias("good"))

    def step(at, x):
        start = at + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        return end, F.when(F.coalesce(x["good"], F.lit(False)), F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")).cast(_SPAN))

    return F.when(text.rlike(pattern), _scanned(steps, "bigint", _SPAN, step)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _replaced(text: Column, spans: Column, mask: str | None) -> Column:
    """The text with each stretch of sorted spans, overlapping ones together, replaced by `mask`, or by
    as many blanks. It is rewritten in pieces, as finding a place takes a walk from the start."""
    kind = "struct<start:bigint,end:bigint,begins:boolean>"

    def stretch(end, s):
        out = F.struct(F.greatest(end, s["start"]).alias("start"), s["end"].alias("end"), (s["start"] >= end).alias("begins")).cast(kind)
        return F.greatest(end, s["end"]), F.when(s["end"] > end, out)

    stretches = _scanned(spans, "bigint", kind, stretch)

    def piece(own, k):
        low, acc = k.cast("bigint") * PIECE, "struct<at:int,out:string>"

        def step(state, s):
            a, b = F.greatest(s["start"] - low, F.lit(0)).cast("int"), F.least(s["end"] - low, F.lit(PIECE)).cast("int")
            fill = F.repeat(F.lit(" "), b - a) if mask is None else F.when(s["begins"] & (s["start"] >= low), F.lit(mask)).otherwise(F.lit(""))
            return F.struct(b.alias("at"), F.concat(state["out"], F.substring(own, state["at"] + 1, a - state["at"]), fill).alias("out")).cast(acc)

        here = F.filter(stretches, lambda s: (s["start"] < low + PIECE) & (s["end"] > low))
        return F.aggregate(here, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(acc), step, lambda state: F.concat(state["out"], F.substring(own, state["at"] + 1, F.lit(PIECE))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)
    return F.when(F.size(spans) > 0, F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def with_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """`docs` with two more columns, whose names come with it: the base spans, and all spans (start,
    kind, end). A null text is empty."""
    t, base, blank, runs, rest, every = (unused(docs.columns, n) for n in ("_text", "_base", "_blank", "_runs", "_rest", "_all"))
    longer = lambda n: lambda hits: F.transform(hits, lambda h: F.length(h) >= n)
    random = lambda hits: F.transform(hits, _is_random)
    docs, text_ = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit(""))), F.col(t)
    assign = _spans(text_, ASSIGN, 0, lambda _: F.transform(F.regexp_extract_all(text_, F.lit(ASSIGN), 2), lambda v: F.length(v) >= 12))
    # shorter runs fail and take up nothing that a longer one needs, so they are not matched at all
    access = _spans(text_, ACCESS.replace("+", "{14,}"), 1, longer(18))
    hexes = _spans(text_, HEX.replace("+", "{16,}"), 2, longer(16))
    docs = docs.withColumn(base, F.array_sort(F.concat(assign, access, hexes)))
    docs = docs.withColumn(blank, _replaced(text_, F.col(base), None))
    docs = docs.withColumn(runs, _spans(F.col(blank), RUN, 3, random))
    docs = docs.withColumn(rest, _replaced(F.col(blank), F.col(runs), None))
    docs = docs.withColumn(every, F.array_sort(F.concat(F.col(base), F.col(runs), _spans(F.col(rest), PART, 3, random))))
    return docs.drop(t, blank, runs, rest), base, every


def _joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for each row of `docs`
    (doc_id, text).

    A span is that of the whole match, in code points, its end exclusive; those of the models lie
    beside the base ones. A null or empty text has no spans, and the digest is that of the empty
    string. A null doc_id stays null; repeated rows are scanned each; no rows give none.
    """
    docs, base, every = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long")
    return docs.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), n(3).alias("n_markov"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with each stretch of spans in `text` replaced by `mask` and n_chars, where there is such
    a column, set to the new length. Texts without spans stay as they are, null too; repeated
    rows are masked each; other columns, of whatever name, stay; no rows give none."""
    found, _, every = with_spans(docs)
    has = F.size(every) > 0
    text = F.when(has, _replaced(F.col("text").cast("string"), F.col(every), mask)).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(has, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(either, ["password", "passwd", "secret", "token"]), either("api") + "_?" + either("key")])
    assign = re.sub(r"\(\?i\)\([^)]*\)", lambda _: f"({names})", ASSIGN).replace("'", "''").replace(r"\x20", " ")

    def spans(kind, pattern, good, texts="d"):
        return f"""SELECT rn, {kind} AS kind, g[i] AS value, {good} AS good,
          CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start,
          CAST(length(hits[i]) AS BIGINT) AS width
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT rn, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
            regexp_extract_all(t, '{pattern}', {2 if kind == 0 else 0}) AS g FROM {texts}) CROSS JOIN learned)"""

    def blanked(texts, found):
        return f"""SELECT rn, coalesce(b.t, {texts}.t) AS t FROM {texts} LEFT JOIN (
          SELECT rn, string_agg(substr(t, before + 1, low - before) || repeat(' ', CAST(stop - low AS INTEGER)), '' ORDER BY low) || substr(any_value(t), max(stop) + 1) AS t
          FROM (SELECT rn, CAST(greatest(start, before) AS INTEGER) AS low, CAST(stop AS INTEGER) AS stop, CAST(before AS INTEGER) AS before
            FROM (SELECT *, coalesce(max(stop) OVER (PARTITION BY rn ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {found}) s
            WHERE stop > before) c JOIN {texts} USING (rn) GROUP BY rn) b USING (rn)"""

    score = f"""list_sum(list_transform(range(1, length(hits[i])), lambda j: w[
      CAST((strpos('{LETTERS}', substr(hits[i], CAST(j AS INTEGER), 1)) - 1) * {len(LETTERS)} + strpos('{LETTERS}', substr(hits[i], CAST(j + 1 AS INTEGER), 1)) AS INTEGER)])) > {LEAST} * (length(hits[i]) - 1)"""
    good = "SELECT rn, kind, start, start + width AS stop FROM {} WHERE good"
    return f"""
WITH learned AS (SELECT [{",".join(map(str, TABLE))}] AS w),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t FROM documents),
b AS ({spans(0, assign, "length(g[i]) >= 12")} UNION ALL {spans(1, ACCESS, "length(hits[i]) >= 18")} UNION ALL {spans(2, HEX, "length(hits[i]) >= 16")}),
base AS ({good.format("b")}),
blank AS MATERIALIZED ({blanked("d", "base")}),
r AS ({spans(3, RUN, score, "blank")}),
runs AS ({good.format("r")}),
rest AS MATERIALIZED ({blanked("blank", "runs")}),
p AS ({spans(3, PART, score, "rest")}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM runs UNION ALL {good.format("p")}),
s AS (SELECT rn, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, count(*) FILTER (kind = 3) AS k,
  string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS own,
  string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS whole FROM every GROUP BY rn)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256,
  coalesce(whole, '') AS spans, coalesce(k, 0) AS n_markov
FROM d LEFT JOIN s USING (rn)
"""


OP3_SQL = _oracle()
