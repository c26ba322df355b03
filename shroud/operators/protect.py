"""Protect and restore: values become keyed tokens, the result is audited, and text that comes back is resolved.

Tokens are keyed: __Z_<namespace>_<KIND>_<8 hex>__ from a BLAKE2b MAC of the value, so retries and micro-batches name a value
alike without shared state. Values are told apart by their NFC form, in their own case, across kinds; a collision of two
values within a namespace and kind is found by collisions() and is an error, never silently merged.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable
from hashlib import blake2b, md5
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.kinds import KINDS
from .batches import by_batch, by_pieces
from .contains import substring_keys, substring_text_keys, with_met
from .kernel import Reading, nfc, occurrences, token_spans
from .known import Hint, Known, Stretches, key
from .spans import matches, utf16
from .vault import nfc as nfc_text

TOKEN = "__Z_[A-Za-z0-9]{4}_[A-Z0-9]+_[A-Za-z0-9]{4,8}__"
PROTECTION = "array<struct<start:int,end:int,kind:string,value:string,token:string>>"
REQUEST = "\n\n--- Request ---\n"


class Naming:
    """Names of one session or conversation: a namespace and a token for each value."""

    def __init__(self, secret: str) -> None:
        self._key = blake2b(secret.encode(), digest_size=32).digest()
        self.namespace = self._mac("session/1/namespace", b"")[:4]

    def _mac(self, label: str, data: bytes) -> str:
        derived = blake2b(label.encode(), key=self._key, digest_size=32).digest()
        return blake2b(data, key=derived, digest_size=32).hexdigest()

    def token(self, kind: str, value: str, again: int = 0) -> str:
        """again: a further token for a value whose own one another value has taken."""
        raw = nfc(value).encode() + (b"\x00%d" % again if again else b"")
        return f"__Z_{self.namespace}_{KINDS[kind]}_{self._mac('session/1/value', len(raw).to_bytes(8, 'big') + raw)[:8].upper()}__"


class _Taken:
    """Spans in order of their starts, with the furthest end so far: what overlaps a place is found by halving."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts, self.reach = [a for a, _ in self.spans], list(accumulate((z for _, z in self.spans), max))

    def overlaps(self, a: int, z: int) -> bool:
        k = bisect_left(self.starts, z)
        return k > 0 and self.reach[k - 1] > a


def fan_out(text: str, findings: list[dict], suggestions: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind): each sure finding protects every place of its text that no finding of another kind overlaps.

    Places of one value never overlap each other, so what is taken is put in order once a value.
    """
    sure = [f for f in findings if suggestions or f["confidence"] == "auto"]
    out = [(f["start"], f["end"], f["kind"]) for f in sure]
    stretches = Stretches(text) if sure else None
    first, later = _Taken([(a, z) for a, z, _ in out]), []
    others = {k: _Taken([(f["start"], f["end"]) for f in findings if f["kind"] != k]) for k in {f["kind"] for f in sure}}
    for value, kind in dict.fromkeys((text[f["start"] : f["end"]], f["kind"]) for f in sure):
        for a, z in occurrences(text, value) if stretches.has(*key(value)) > 1 else ():  # one place is its own
            at = bisect_left(later, (a, a, ""))
            near = later[max(0, at - 1) : at + 1]  # later ones are apart from each other
            if not first.overlaps(a, z) and not others[kind].overlaps(a, z) and not any(a < e and s < z for s, e, _ in near):
                insort(later, (a, z, kind))
    return sorted(out + later)


def protect(scanned: DataFrame, secret: str, text_col: str = "text", col: str = "findings", suggestions: bool = False, already: str | None = None) -> DataFrame:
    """Adds protections (array) and protected: the text with each protected place as its token, form feeds as line feeds.

    Columns of these names are replaced. The kind of a value's first place names its token everywhere.
    already: a column of protections made before, which stay and which no other place may touch.
    """
    base = scanned.drop("protections", "protected")
    return by_batch(base, _protecting(secret, text_col, col, suggestions, already), T.StructType([*base.schema.fields, *T._parse_datatype_string(_PROTECTED).fields]))


_PROTECTED = f"protections {PROTECTION}, protected string"


def _protecting(secret: str, text_col: str, col: str, suggestions: bool, already: str | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("token", pa.string())]))

    naming = Naming(secret)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        spans, texts = [], []
        before = b.column(already).to_pylist() if already else [None] * b.num_rows
        for text, found, old in zip(b.column(text_col).to_pylist(), b.column(col).to_pylist(), before, strict=True):
            first: dict[str, str] = {}
            made, parts, at = list(old or []), [], 0
            for a, z, k in fan_out(text or "", found or [], suggestions):
                if not any(a < p["end"] and p["start"] < z for p in old or ()):
                    value = text[a:z]
                    made.append({"start": a, "end": z, "kind": k, "value": value, "token": naming.token(first.setdefault(nfc(value), k), value)})
            made.sort(key=lambda p: p["start"])
            for p in made:
                parts += [text[at : p["start"]], p["token"]]
                at = p["end"]
            spans.append(made)
            texts.append(None if text is None else "".join([*parts, text[at:]]).replace("\f", "\n"))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind), pa.array(texts, pa.string())], names=[*b.schema.names, "protections", "protected"])

    return run


def protections(protected: DataFrame) -> DataFrame:
    """A row a protected place, with the document's other columns but its texts and arrays."""
    rest = [f.name for f in protected.schema.fields if f.name not in ("text", "protected", "findings", "protections", "plain_words", "start", "end", "kind", "value", "token")]
    return protected.select(*rest, F.explode("protections").alias("p")).select(*rest, "p.*")


def token_store(protected: DataFrame) -> DataFrame:
    """token, value, kind: what a session knows; each token once."""
    return protections(protected).groupBy("token").agg(F.min("value").alias("value"), F.min("kind").alias("kind"))


def collisions(protected: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value (compared in NFC by their MAC): must be empty before anything leaves."""
    return protections(protected).groupBy("token").agg(F.count_distinct("value").alias("values")).where(F.col("values") > 1)


def reminted(protected: DataFrame, secret: str, text_col: str = "text", naming: Naming | None = None) -> DataFrame:
    """protected with a token of its own for every value: where several share one, the least keeps it and the others get further ones.

    Collisions of 32-bit tails are few (about a hundred in a million values); they are refused beyond MOST_STORED, never cut.
    """
    shared = collisions(protected).select("token")
    rows = protections(protected).join(shared, "token", "left_semi").groupBy("token", "value").agg(F.min("kind").alias("kind")).orderBy("token", "value").limit(MOST_STORED + 1).collect()
    if len(rows) > MOST_STORED:
        raise ValueError(f"over {MOST_STORED} values share tokens; take one session's")
    namer, fresh, taken, before = naming or Naming(secret), {}, {r["token"] for r in rows}, None
    for r in rows:
        if r["token"] == before:
            tokens = (namer.token(r["kind"], r["value"], n) for n in range(1, 65))
            fresh[r["token"], r["value"]] = one = next(t for t in tokens if t not in taken)
            taken.add(one)
        before = r["token"]
    if not fresh:
        return protected
    new = protected.sparkSession.sparkContext.broadcast(fresh)
    kind = protected.select("protections").schema.fields[0].dataType
    arrow_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("token", pa.string())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        spans, texts = [], []
        for text, places in zip(b.column(text_col).to_pylist(), b.column("protections").to_pylist(), strict=True):
            places = [p | {"token": new.value.get((p["token"], p["value"]), p["token"])} for p in places or []]
            at, parts = 0, []
            for p in places:
                parts += [text[at : p["start"]], p["token"]]
                at = p["end"]
            spans.append(places)
            texts.append(None if text is None else "".join([*parts, text[at:]]).replace("\f", "\n"))
        columns = [pa.array(spans, arrow_kind) if n == "protections" else pa.array(texts, pa.string()) if n == "protected" else b.column(n) for n in b.schema.names]
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return by_batch(protected, run, T.StructType([T.StructField(f.name, kind if f.name == "protections" else f.dataType) for f in protected.schema.fields]))


def payload(protected: DataFrame, request: Column, out_col: str = "payload", text_col: str = "text") -> DataFrame:
    """Adds the text that may leave: the protected text, then the request; the tokens that its answer may carry; `counts`, how many
    there are of each kind; and `pages`, where pages after the first begin in it, in UTF-16 units."""
    places = F.col("protections")
    tokens = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["token"])))
    kind = lambda t: F.split(t, "_")[4]
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform("allowed", kind))), lambda k: F.struct(k, F.size(F.filter("allowed", lambda t: kind(t) == k)))))
    shift = lambda at: F.aggregate(F.filter(places, lambda p: p["end"] <= at), F.lit(0), lambda a, p: a + F.length(p["token"]) - (p["end"] - p["start"]))
    breaks = F.filter(matches(F.col(text_col), "\f"), lambda m: ~F.exists(places, lambda p: (p["start"] <= m["start"]) & (m["start"] < p["end"])))
    out = protected.withColumn(out_col, F.concat(F.col("protected"), F.lit(REQUEST), request)).withColumn("allowed", tokens).withColumn("counts", counts)
    return out.withColumn("pages", F.transform(breaks, lambda m: utf16(F.col("protected"), m["end"] + shift(m["start"]))))


def audit(protected: DataFrame, text_col: str = "text", out: str = "protected", request: str | None = None, session: str | None = None) -> DataFrame:
    """A row for each document and secret that it protects or that stands in what leaves: how often it stands there, outside
    tokens, and how often it may.

    Secrets are all values that any document of the session protects (session: its column; without it all rows are one).
    What leaves is `out`, the payload where a request goes along; what entered is the text and that request (a column). A
    secret may stand as often as in what entered less the places replaced. Both sides are counted by one expression, in NFC and
    as raw substrings, so a value inside a longer word counts. Texts meet secrets by their rarest run of characters
    (contains.met), however many there are.
    """
    scope = [session] if session else []
    keep = [c for c in protected.columns if c not in ("protections", "findings", "plain_words", text_col, out, request, "secret", "left", "allowed", "leak")]
    entered = F.coalesce(F.col(text_col), F.lit(""))
    if request:
        entered = F.concat(entered, F.lit(REQUEST), F.coalesce(request, F.lit("")))
    values = nfc_text(F.array_join(F.transform("protections", lambda p: p["value"]), "\x01"))
    sides = protected.select(*keep, values.alias("own__"), nfc_text(without_tokens(entered)).alias("in__"), nfc_text(without_tokens(F.coalesce(out, F.lit("")))).alias("out__"))
    secrets = sides.select(*scope, F.explode(F.split("own__", "\x01")).alias("spelling")).where("spelling != ''").distinct()
    met = with_met(sides, secrets, "out__", "met__", session, keys_of=substring_keys, keys_in=substring_text_keys)
    schema = T.StructType([*(met.schema[c] for c in keep), *T._parse_datatype_string("c__ array<struct<secret:string,left:long,allowed:long,leak:boolean>>").fields])
    kind = pa.list_(pa.struct([("secret", pa.string()), ("left", pa.int64()), ("allowed", pa.int64()), ("leak", pa.bool_())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for own, before, after, found in zip(*(b.column(c).to_pylist() for c in ("own__", "in__", "out__", "met__")), strict=True):
            replaced, counted = Counter(v for v in (own or "").split("\x01") if v), []
            for v in sorted({*replaced, *(s["spelling"] for s in found or ())}):
                left, allowed = after.count(v), max(0, before.count(v) - replaced[v])
                if left or v in replaced:
                    counted.append({"secret": md5(v.encode()).hexdigest(), "left": left, "allowed": allowed, "leak": left > allowed})
            rows.append(counted)
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, kind)], names=[*keep, "c__"])

    return by_batch(met, run, schema).select(*keep, F.explode("c__").alias("c__")).select(*keep, "c__.*")


SEGMENTS = "array<struct<text:string,piece:string>>"


def restore_text(raw: str, values: dict[str, str], allowed: set[str] | None = None) -> list[tuple[str, str]]:
    """(text, piece): words as they are, Value where a token resolves, Unresolved where it may not or can't."""
    out, at = [], 0
    for a, z in token_spans(raw):
        if a > at:
            out.append((raw[at:a], "Words"))
        token = raw[a:z]
        known = token in values and (allowed is None or token in allowed)
        out.append((values[token], "Value") if known else (token, "Unresolved"))
        at = z
    if at < len(raw):
        out.append((raw[at:], "Words"))
    return out


def restore(returned: DataFrame, text_col: str = "text", values_col: str = "tokens", allowed_col: str | None = None) -> DataFrame:
    """Adds segments, restored and unresolved (distinct tokens). values_col: map of token to value, for this row's session only."""
    base = returned.drop("segments", "restored", "unresolved")
    schema = T.StructType([*base.schema.fields, *T._parse_datatype_string(f"segments {SEGMENTS}, restored string, unresolved array<string>").fields])
    kind = pa.list_(pa.struct([("text", pa.string()), ("piece", pa.string())]))

    def run(batches):
        for b in batches:
            texts, values = b.column(text_col).to_pylist(), b.column(values_col).to_pylist()
            allowed = b.column(allowed_col).to_pylist() if allowed_col else [None] * len(texts)
            all_ = [restore_text(t or "", dict(v or []), None if a is None else set(a)) for t, v, a in zip(texts, values, allowed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([[{"text": t, "piece": p} for t, p in s] for s in all_], kind), pa.array([None if t is None else "".join(x for x, _ in s) for t, s in zip(texts, all_, strict=True)], pa.string()), pa.array([list(dict.fromkeys(t for t, p in s if p == "Unresolved")) for s in all_], pa.list_(pa.string()))],
                names=[*b.schema.names, "segments", "restored", "unresolved"],
            )

    return by_pieces(base, run, schema)


#: What begins like a token, up to the next pair of underscores: one that isn't a token hides what stands before its own end.
LIKE_A_TOKEN = "(?s)__Z_.*?__"


def _tokens(text: Column) -> Column:
    """The tokens of a text, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(LIKE_A_TOKEN), F.lit(0)), lambda t: t.rlike(f"^{TOKEN}$"))


def without_tokens(text: Column, by: str = "\x00") -> Column:
    """The text with each token as one character."""
    between, like = F.split(text, LIKE_A_TOKEN, -1), F.regexp_extract_all(text, F.lit(LIKE_A_TOKEN), F.lit(0))
    kept = F.zip_with(between, like, lambda p, t: F.concat(p, F.when(t.isNull(), "").when(t.rlike(f"^{TOKEN}$"), by).otherwise(t)))
    return F.array_join(kept, "")


def tokens_in(returned: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each token of a text: its place in order, token and namespace. Native."""
    rest = [c for c in returned.columns if c not in (text_col, "n", "token", "namespace")]
    exploded = returned.select(*rest, F.posexplode(_tokens(F.col(text_col))).alias("n", "token"))
    return exploded.withColumn("namespace", F.substr("token", F.lit(5), F.lit(4)))


def resolve(tokens: DataFrame, *stores: DataFrame) -> DataFrame:
    """tokens_in() with value: from the first of the stores (token, value) that has it: session, keyed names, blocks. Left joins."""
    out, found = tokens, []
    for k, s in enumerate(stores):
        found.append(f"value__{k}")
        out = out.join(s.select("token", F.col("value").alias(found[-1])).dropDuplicates(["token"]), "token", "left")
    return out.withColumn("value", F.coalesce(*found)).drop(*found)


def returned_statistics(resolved: DataFrame) -> DataFrame:
    """By namespace: tokens, distinct ones brought back, distinct ones unresolved."""
    known = F.when(F.col("value").isNotNull(), F.col("token"))
    unknown = F.when(F.col("value").isNull(), F.col("token"))
    return resolved.groupBy("namespace").agg(F.count("*").alias("tokens"), F.count_distinct(known).alias("brought_back"), F.count_distinct(unknown).alias("unresolved"))


def rename_all(texts: DataFrame, old_to_new: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each token replaced by its new name (old, new); others stay. The pieces between tokens are joined again in order.

    A row a token, with what stands before it (and after the last); a text without any never meets the names, so no key of the
    join is shared by all texts.
    """
    like, between = F.regexp_extract_all(F.col(text_col), F.lit(LIKE_A_TOKEN), F.lit(0)), F.split(F.col(text_col), LIKE_A_TOKEN, -1)
    held = texts.select(id_col, F.col(text_col).alias("t__"), like.alias("k__"), between.alias("b__"))
    last = F.when(F.col("n") == F.size("k__") - 1, F.element_at("b__", -1)).otherwise("")
    pieces = held.where(F.size("k__") > 0).select(id_col, "k__", "b__", F.posexplode("k__").alias("n", "token")).select(id_col, "n", F.get("b__", F.col("n")).alias("before"), "token", last.alias("after"))
    met = pieces.join(old_to_new.where(F.col("old").rlike(f"^{TOKEN}$")), F.col("token") == F.col("old"), "left").select(id_col, "n", F.concat("before", F.coalesce("new", "token"), "after").alias("s"))
    plain = held.where(F.size("k__") == 0).select(id_col, F.lit(0).alias("n"), F.col("t__").alias("s"))
    both = F.array_sort(F.collect_list(F.struct("n", "s")))
    return met.unionByName(plain).groupBy(id_col).agg(F.array_join(F.transform(both, lambda x: x["s"]), "").alias(text_col))


_KIND_OF = {word: kind for kind, word in KINDS.items()}
#: Values that a session knows at most where a question is protected; more have to be split by session.
MOST_STORED = 200_000


def protect_lines(lines: DataFrame, stores: DataFrame, known, secret: str, text_col: str = "text") -> DataFrame:
    """A question's text: tokens it carries stay, values that the session already has (stores: token, value) take their tokens,
    of those that begin together the longest; the rest is scanned, and suggestions are protected too.

    The store is one session's, of bounded size: it is refused beyond MOST_STORED values, never cut.
    """
    from .scan import walk

    rows = stores.where(F.trim("value") != "").select("token", "value").distinct().orderBy("value", "token").limit(MOST_STORED + 1).collect()
    if len(rows) > MOST_STORED:
        raise ValueError(f"over {MOST_STORED} values in the store; take one session's")
    tokens = {nfc(r["value"]): r["token"] for r in reversed(rows)}
    session = lines.sparkSession.sparkContext.broadcast((Known([Hint(v, "Custom", "Always", 0) for v in tokens]), tokens))
    base, walked, schema = walk(lines.drop("protections", "protected"), known, text_col)
    protected = _protecting(secret, text_col, "findings", True, "known__")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("token", pa.string())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        """One pass, so one worker process a task: scanned, met with the session's values, protected."""
        b, (index, names) = walked(b), session.value
        out = []
        for text in b.column(text_col).to_pylist():
            held, taken, end = token_spans(text or ""), [], 0
            for a, z, spelling in sorted(index.places(text or ""), key=lambda p: (p[0], -p[1])):
                if a >= end and not any(a < y and x < z for x, y in held):
                    taken.append({"start": a, "end": z, "kind": _KIND_OF.get(names[spelling].split("_")[4], "Custom"), "value": text[a:z], "token": names[spelling]})
                    end = z
            out.append(taken)
        found = b.column("findings")
        free = [[f for f in fs if not any(f["start"] < k["end"] and k["start"] < f["end"] for k in ks)] for fs, ks in zip(found.to_pylist(), out, strict=True)]
        columns = [pa.array(free, found.type) if n == "findings" else c for n, c in zip(b.schema.names, b.columns, strict=True)]
        made = protected(pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=[*b.schema.names, "known__"]))
        keep = [n for n in made.schema.names if n != "known__"]
        return pa.RecordBatch.from_arrays([made.column(n) for n in keep], names=keep)

    return by_batch(base, run, T.StructType([*schema.fields, *T._parse_datatype_string(_PROTECTED).fields]))


def find_in_document(scanned: DataFrame, needle: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Places of a value and what covers them: Protected, Waiting (a suggestion) or Clear. Takes scanned or protected documents."""
    covered = "protections" if "protections" in scanned.columns else None

    def run(batches):
        for b in batches:
            out = []
            for i, text, found, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sure = [f for f in found or [] if f["confidence"] == "auto"] + (more[0] or [] if more else [])
                over = lambda spans, a, z: any(a < f["end"] and f["start"] < z for f in spans)
                out += [(i, a, z, "Protected" if over(sure, a, z) else "Waiting" if over(found or [], a, z) else "Clear") for a, z in occurrences(text or "", needle)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "start", "end", "state"])

    return by_pieces(scanned.select(F.col(id_col).cast("long").alias(id_col), text_col, "findings", *[covered] * bool(covered)), run, "doc_id long, start int, end int, state string")


def whole_words(text: str, start: int, end: int) -> tuple[int, int]:
    """A selection moved to the line that holds most of it, grown to word edges over joiners, then trimmed of marks."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    a, z = max(((max(start, x), min(end, y)) for x, y in lines), key=lambda s: len(text[s[0] : s[1]].replace(" ", "")) if s[0] < s[1] else -1)
    inner = lambda k: 0 <= k < len(text) and (text[k].isalnum() or (text[k] in "-'’./" and 0 < k < len(text) - 1 and text[k - 1].isalnum() and text[k + 1].isalnum()))
    while a > 0 and inner(a - 1) and inner(a):
        a -= 1
    while z < len(text) and inner(z) and inner(z - 1):
        z += 1
    while a < z and not text[a].isalnum():
        a += 1
    while z > a and not text[z - 1].isalnum():
        z -= 1
    return a, z


def selections(docs: DataFrame, text_col: str = "text", start_col: str = "start", end_col: str = "end") -> DataFrame:
    """docs with start and end moved to whole words; a null text or offset stays as it is."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(b.column(c).to_pylist() for c in (text_col, start_col, end_col)), strict=True)
        moved = [(a, z) if None in (t, a, z) else whole_words(t, a, z) for t, a, z in rows]
        new = {start_col: [a for a, _ in moved], end_col: [z for _, z in moved]}
        return pa.RecordBatch.from_arrays([pa.array(new[n], b.column(n).type) if n in new else b.column(n) for n in b.schema.names], names=b.schema.names)

    return by_batch(docs, run, docs.schema)


def words_of(text: str) -> list[tuple[int, int, str]]:
    """Words with marks trimmed off their edges."""
    doc = Reading(text)
    return list(zip(doc.starts, doc.ends, doc.words, strict=True))
