"""Personal data: base patterns, and candidates accepted by boosted trees.

Generators of high recall propose spans that overlap: addresses with ``at`` and
``dot`` spelled out, and in each run of digits and separators every stretch of
whole groups with 7 to 19 digits. Each candidate has bits for its format
(separators, number of digits, checksum, octets) and its context (what stands
before and after). The marks that make a span a base span, a plus and an at sign,
are no features.

Boosted trees learn from all candidates of the corpus, counted by bits. Positive
are base spans and base spans rewritten to forms that the base patterns miss
(addresses spelled out, numbers with brackets, cards in a row of numbers or with
blanks). Negative are candidates that cannot be what they look like (digits,
checksum or octets wrong) and plain numbers without brackets or a telling word
before them. Other candidates teach nothing; they are what the trees decide on.
The threshold is the lowest score down to which, at every score, rewritten spans
and negatives have the wanted precision. Of accepted candidates that overlap, the one of the
highest score stays, then the longest, then the first.

Defined cases: a null text counts as empty and has no spans; other columns play
no part; repeated rows each give a row; an empty table gives no rows. Positions
are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.session import materialize

KINDS = ("email", "ip", "card", "phone")
# Base patterns. Possessive where what follows cannot take back a character; a
# match starts where a run starts or where the last match ended, so that a long
# run is scanned once. Neither changes what is found.
LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
PATTERNS = {
    "email": LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}"}
LOOSE_EMAIL = LOCAL + r"(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"
LOOSE_NUMBER = r"(?<![0-9])\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+"
MOST_DIGITS = 19
CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|ip|address)[^a-z]{0,4}$"
PRECISION = 0.95
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str, guard: Column) -> Column:
    """All matches from left to right as (start, end, value)."""
    def spans(x: Column) -> Column:
        def step(a: Column, pair: Column) -> Column:
            start = a["at"] + F.length(pair["gap"])
            end = start + F.length(pair["hit"])
            one = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

        pairs = F.zip_with(x["hits"], F.slice(x["gaps"], 1, F.size(x["hits"])), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(pairs, start, step, lambda a: a["out"])

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(guard, _let(both, spans)).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    def total(s: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            d = F.substring(s, i + 1, F.lit(1)).try_cast("int")
            return a + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        return F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), F.lit(0), add)

    return F.when(F.length(number) > 0, _let(F.reverse(number), total) % 10 == 0).otherwise(False)


def octets(value: Column) -> Column:
    def low(part: Column) -> Column:
        return _let(F.ltrim(part, F.lit("0")), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))

    return F.forall(F.split(value, r"\."), low)


def base_spans(text: Column) -> dict[str, Column]:
    """The valid matches of each kind."""
    guards = {"email": text.contains("@"), "phone": text.contains("+")} | {k: text.rlike(p) for k, p in GUARDS.items()}
    raw = {kind: found(text, PATTERNS[kind], guards[kind]) for kind in KINDS}

    def card(x: Column) -> Column:
        return _let(digits(x["value"]), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))

    return {
        "email": raw["email"], "ip": F.filter(raw["ip"], lambda x: octets(x["value"])), "card": F.filter(raw["card"], card),
        "phone": F.filter(raw["phone"], lambda x: F.length(digits(x["value"])).between(10, 15)),
    }


#: Names of the bits of a candidate, in order.
BITS = ("kind_email", "kind_ip", "kind_card", "brackets", "dots", "blanks", "bare", "ten_digits", "phone_digits",
        "card_digits", "checksum", "octets", "after_word", "before_word", "context", "spelled", "letters_last")


def _bit(code: Column, name: str) -> Column:
    return code.bitwiseAND(1 << BITS.index(name)) != 0


def _lesson(kind: Column, code: Column, same: Column, meets: Column) -> Column:
    """What a candidate teaches: 1 if it is a base span, 0 if it cannot be personal data, null if that is open."""
    wrong = F.lit(False)
    for name, right in (("ip", "octets"), ("card", "checksum"), ("phone", "phone_digits")):
        wrong = wrong | ((kind == name) & ~_bit(code, right))
    plain = (kind == "phone") & ~_bit(code, "brackets") & ~_bit(code, "context")
    return F.when(F.coalesce(same == kind, F.lit(False)), 1).when(wrong, 0).when(meets, None).when(plain, 0)


def _candidate(x: Column, email: bool) -> Column:
    """A span with its kind and bits."""
    v, n = x["value"], F.length(digits(x["value"]))
    is_ip = v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    kind = F.lit("email") if email else F.when(is_ip, "ip").when(
        v.startswith("+") | v.contains("(") | (n < 14), "phone").otherwise("card")  # the plus tells the kind only
    bits = [
        kind == "email", kind == "ip", kind == "card", v.contains("("), F.lit(False) if email else v.contains("."),
        F.lit(False) if email else v.contains(" "), v.rlike(r"^\+?[0-9]+$"), n >= 10, n.between(10, 15), n.between(14, 19),
        F.lit(False) if email else F.when(n.between(14, 19), luhn(digits(v))).otherwise(False),
        F.lit(False) if email else F.when(is_ip, octets(v)).otherwise(False),
        x["before"].rlike("[A-Za-z0-9]$"), x["after"].rlike("^[A-Za-z0-9]"), x["before"].rlike(CONTEXT), v.rlike(r"[\[(](?:at|dot)[\])]"),
        v.rlike("[A-Za-z]{2,}$"),
    ]
    code = F.lit(0)
    for i, bit in enumerate(bits):
        code = code + F.when(bit, 1 << i).otherwise(0)
    def known(y: Column) -> Column:
        return F.struct(y["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), y["code"].alias("code"),
                        x["meets"].alias("meets"), _lesson(y["kind"], y["code"], x["same"], x["meets"]).cast("int").alias("y"))

    return _let(F.struct(kind.alias("kind"), code.alias("code")), known)


WINDOW, WIDEST, NEAR = 64, 80, 16  # a stretch has at most 19 digits with two separators between, and a bracket and a plus
STRETCHES = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string,same:string,meets:boolean>>"
BASE = "array<struct<start:bigint,end:bigint,kind:string>>"


def _beside(x: dict[str, Column], base: Column) -> list[Column]:
    """The kind of the base span that a span equals, and whether it meets any."""
    same = F.filter(base, lambda b: (b["start"] == x["start"]) & (b["end"] == x["end"]))
    meets = F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return [F.try_element_at(same, F.lit(1))["kind"].alias("same"), meets.alias("meets")]


def stretches(text: Column, runs: Column, base_spans: Column) -> Column:
    """Every stretch of whole groups of digits in each run, with 7 to ``MOST_DIGITS`` digits, the text around it and how it lies to base spans.

    Groups are looked up in windows of the run, each for the stretches that begin
    in it, so a long run takes time in proportion. A group has a digit at least, so
    a group begins few stretches.
    """
    def of_run(run: Column) -> Column:
        def of_window(w: Column) -> Column:
            base = F.greatest(run["start"] + w * WINDOW - NEAR - 1, F.lit(0))
            part = F.substring(text, (base + 1).cast("int"), F.lit(NEAR + WINDOW + WIDEST + 2))

            def ends(x: Column) -> Column:
                low = run["start"] + w * WINDOW - x["base"]
                groups = F.filter(x["found"], lambda g: (x["base"] + g["start"] >= run["start"]) & (x["base"] + g["end"] <= run["end"]))

                def begin(whole: Column, g: Column, i: Column) -> Column:
                    # A plus or bracket before a group belongs to it, and all that comes before the run's first.
                    mark = F.when(F.substring(x["part"], g["start"].cast("int"), F.lit(1)).isin("+", "("), 1).otherwise(0)
                    first = F.when((w == 0) & (i == 0), run["start"] - x["base"]).otherwise(g["start"] - F.when(g["start"] > 0, mark).otherwise(0))
                    near = F.greatest(first - NEAR, F.lit(0).cast("long"))

                    def one(h: Column) -> Column:
                        start, end = x["base"] + first, x["base"] + h["end"]
                        return F.struct(
                            start.alias("start"), end.alias("end"),
                            F.substring(x["part"], (first + 1).cast("int"), (h["end"] - first).cast("int")).alias("value"),
                            F.substring(x["part"], (near + 1).cast("int"), (first - near).cast("int")).alias("before"),
                            F.substring(x["part"], (h["end"] + 1).cast("int"), F.lit(1)).alias("after"),
                            *_beside({"start": start, "end": end}, x["close"]))

                    here = (g["start"] >= low) & (g["start"] < low + WINDOW)
                    all_ends = F.filter(F.transform(F.slice(whole, i + 1, F.lit(MOST_DIGITS)), one),
                                        lambda y: F.length(digits(y["value"])).between(7, MOST_DIGITS))
                    return F.when(here, all_ends).otherwise(F.array().cast(STRETCHES))

                return _let(groups, lambda y: F.flatten(F.transform(y, lambda g, i: begin(y, g, i))))

            close = F.filter(base_spans, lambda b: (b["end"] > base) & (b["start"] < base + NEAR + WINDOW + WIDEST + 2))
            return _let(F.struct(base.alias("base"), part.alias("part"), found(part, "[0-9]+", F.lit(True)).alias("found"), close.alias("close")), ends)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((run["end"] - run["start"] - 1) / WINDOW).cast("int")), of_window))

    return F.flatten(F.transform(runs, of_run))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, email, ip, card, phone, candidates), written once: what follows needs no texts."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    drop_value = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    rows = rows.withColumns({k: drop_value(v) for k, v in base_spans(text).items()})
    named = lambda kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    rows = rows.withColumn("every", F.concat(*[F.transform(k, named(k)) for k in KINDS]))

    def around(x: Column) -> Column:
        near = F.greatest(x["start"] - NEAR, F.lit(0).cast("long"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
                        F.substring(text, (near + 1).cast("int"), (x["start"] - near).cast("int")).alias("before"),
                        F.substring(text, (x["end"] + 1).cast("int"), F.lit(1)).alias("after"),
                        *_beside(x, F.filter("every", lambda b: b["kind"] == "email")))

    emails = F.transform(found(text, LOOSE_EMAIL, text.contains("@") | text.rlike(r"[\[(]at[\])]")), around)
    numbers = stretches(text, found(text, LOOSE_NUMBER, text.rlike(r"[0-9](?:[\x20().\-/]{0,2}[0-9]){6}")), F.col("every"))
    loose = F.concat(F.transform(emails, lambda x: _candidate(x, True)), F.transform(numbers, lambda x: _candidate(x, False)))
    return materialize(rows.select("id", *KINDS, loose.alias("candidates")), "spans")


def lessons(spans: DataFrame) -> DataFrame:
    """(code, y, rewritten, n): what the corpus teaches, a row for each kind of candidate."""
    told = F.filter("candidates", lambda x: x["y"].isNotNull())
    seen = spans.select(F.explode(told).alias("c")).groupBy("c.kind", "c.code", "c.y").agg(F.count("*").cast("double").alias("n"))
    seen = materialize(seen, "codes")
    email, phone, code = F.col("kind") == "email", F.col("kind") == "phone", F.col("code")
    other = F.when(email, F.array(code.bitwiseOR(1 << BITS.index("spelled")))).when(
        phone, F.array(code.bitwiseOR(1 << BITS.index("brackets")))).otherwise(F.array(code, code.bitwiseOR(1 << BITS.index("blanks"))))
    rewritten = seen.filter("y = 1 and kind <> 'ip'").select(F.explode(other).alias("code"), "y", F.lit(True).alias("rewritten"), "n")
    # A spelled address that ends without letters is none.
    cut = F.col("code").bitwiseAND(~(1 << BITS.index("letters_last"))).alias("code")
    decoys = rewritten.filter(_bit(F.col("code"), "spelled")).select(cut, F.lit(0).alias("y"), "rewritten", "n")
    return seen.select("code", "y", F.lit(False).alias("rewritten"), "n").unionByName(rewritten).unionByName(decoys)


def accepted_codes(spans: DataFrame, precision: float = PRECISION, rounds: int = 20) -> dict[int, float]:
    """The codes whose calibrated score passes, with the scores; there are as many codes as kinds of candidates, not as candidates."""
    table = materialize(lessons(spans).groupBy("code", "y", "rewritten").agg(F.sum("n").alias("n")), "lessons")
    if len(table.select("y").distinct().collect()) < 2:
        return {}

    def rows(codes: DataFrame) -> DataFrame:
        bits = [F.col("code").bitwiseAND(1 << i).cast("boolean").cast("double").alias(b) for i, b in enumerate(BITS)]
        return VectorAssembler(inputCols=list(BITS), outputCol="features").transform(codes.select("*", *bits))

    trees = GBTClassifier(labelCol="y", weightCol="n", maxIter=rounds, maxDepth=3, stepSize=0.3, seed=3, maxBins=2).fit(
        rows(table.withColumn("y", F.col("y").cast("double"))))
    score = F.round(vector_to_array("probability")[1], 6).alias("p")
    scored = trees.transform(rows(table.filter(F.col("rewritten") | (F.col("y") == 0)).coalesce(1))).select("n", "y", score)
    steps = scored.groupBy("p").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("y")).alias("true"))
    # Down to the first score at which too many are wrong.
    good = steps.withColumn("good", F.min((F.col("true") / F.col("all") >= precision).cast("int")).over(Window.orderBy(F.desc("p")))).filter("good = 1")
    least = good.agg(F.min("p")).first()[0]
    if least is None:
        return {}
    every = spans.select(F.explode("candidates.code").alias("code")).distinct()
    return {r["code"]: r["p"] for r in trees.transform(rows(every)).select("code", score).filter(F.col("p") >= least).collect()}


def apart(spans: Column) -> Column:
    """Of overlapping (p, start, kind, end), the one of the highest score, then the longest, then the first; as sorted (start, kind, end)."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct((-x["p"]).alias("a"), (x["start"] - x["end"]).alias("b"), x["start"].alias("start"),
                                                               x["kind"].alias("kind"), x["end"].alias("end"))))
    kept = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def add(out: Column, x: Column) -> Column:
        over = F.exists(out, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"]))
        one = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
        return F.when(over, out).otherwise(F.concat(out, F.array(one)))

    return F.array_sort(F.aggregate(order, kept, add))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row for each document: id, base and added, both sorted arrays of (start, kind, end)."""
    spans = _spans(docs, id_col, text_col)
    codes = accepted_codes(spans, precision)
    of_kind = lambda i: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"))
    base = F.concat(*[F.transform(k, of_kind(i)) for i, k in enumerate(KINDS)])
    number = lambda x: F.array_position(F.lit(list(KINDS)), x["kind"]).cast("int") - 1
    known = F.lit(sorted(codes)).cast("array<int>")
    points = F.lit([codes[c] for c in sorted(codes)]).cast("array<double>")
    taken = F.filter("candidates", lambda x: ~x["meets"] & F.array_contains(known, x["code"]))
    rated = F.transform(taken, lambda x: F.struct(F.element_at(points, F.array_position(known, x["code"]).cast("int")).alias("p"),
                                                  x["start"].alias("start"), number(x).alias("kind"), x["end"].alias("end")))
    rows = spans.select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.array_sort(base).alias("base"),
                        (rated if codes else F.array().cast("array<struct<p:double,start:bigint,kind:int,end:bigint>>")).alias("taken"))
    return rows.select("id", *[f"n_{k}" for k in KINDS], "base", apart(F.col("taken")).alias("added"))


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (sorted by start) replaced by its kind in brackets."""
    names = F.lit(list(KINDS))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), x["start"] - a["at"]).cast("int"))
        mark = F.when(x["start"] >= a["at"], F.concat(F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], gap, mark).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
