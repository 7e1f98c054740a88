"""Secret scans: patterns, and a randomness test battery with false-discovery control.

Three patterns (assign, access, hex) find the base spans. The battery adds spans of kind
``random``: runs of 20 or more characters of the base64 alphabets that hold a digit and
a letter, looked for in what base spans leave of a text (kind after kind). Each run's encoding is inferred (hex, base32,
base62, base64) and its characters' values in that alphabet are tested three times against
uniform randomness: chi-squared over the alphabet (Wilson-Hilferty), Wald-Wolfowitz runs of
values above the middle, and lag-one serial correlation. Fisher's sum, -2 ln of the three
p-values, says how far a run is from random.

What that sum is in ordinary runs is measured over the corpus: every text, the runs left out, is written
as runs once an encoding: squeezed to the characters of the encoding, words capitalised (base62) or joined by a separator (base64),
and cut into windows from its first character to its last, each with two digits at the end, since runs hold one. A text's windows have the least length of one band, by hash,
or of the longest band that fits into it. A run's p-value against being ordinary is the share of windows
of its encoding and band that come as close to randomness, (1 + closer ones) / (1 + all), so that no distribution
is assumed; shorter windows look more random, so that a band's runs are judged strictly. Windows are rows, and their tests
are worked out from the six bits of their values, each of them a number of one bit a character, which gives the same sums as ``battery``.
Benjamini-Hochberg at ``FDR``, in each stratum of encoding and band, decides which are
reported. Sums enter rounded up to bins, so all this reads a bounded histogram.

Positions are code points from 0, ends exclusive: matches are wrapped in private-use
characters (such characters of a text are first replaced by one that no pattern matches)
and lengths are added up, in slices, so that texts with very many matches stay cheap: the work
grows with a text's length. Only DataFrame functions are used.

Defined cases: null and empty texts have no spans; repeated rows are each scanned, and each
counts in the histogram; runs whose sums share a bin are reported together or not at all; in a
corpus with fewer windows of a stratum than 1 / ``FDR``, times its runs over those reported, none is reported there; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Kinds in order, and their patterns; the third value is the least length of a match, or of group 2 for assign.
#: Classes that every character of a text is held against are spelt out: Java looks those up in a table, but tries ranges one by one.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ASSIGN = r"""(?=[AaPpSsTt])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 12), ("access", r"AKIA[A-Z0-9]{14,}", 18), ("hex", f"[{DIGITS}abcdef]{{16,}}", 16)]
RUN = f"[{UPPER}{LOWER}{DIGITS}+/_-]{{20,}}={{0,2}}"
OPEN, CLOSE, OTHER, BLANK = "\ue000", "\ue001", "\ufffd", "\ue002"
SLICE = 256
#: Share of false discoveries; bins of Fisher's sum.
FDR, BINS, STEP = 0.05, 400, 0.5
#: By encoding: whole pattern of a run, and alphabet.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "ABCDEF"),
    "base32": (r"^[A-Z2-7]+$", UPPER + "234567"),
    "base62": (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    "base64": (r"", UPPER + LOWER + DIGITS + "+/"),
}
#: Least lengths of the bands.
LENGTHS = (20, 32, 48, 96)
#: Bits of a value, characters of a window whose equal bits are held in one number, and characters that are decoded to one.
BITS, HALF, GROUP = 6, 48, 8


def _value(name: str, pattern: str, m: Column) -> Column:
    return F.regexp_extract(m, pattern, 2) if name == "assign" else m


def _unmarked(text: Column) -> Column:
    """``text`` without the characters that mark matches."""
    return F.when(reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in (OPEN, CLOSE, BLANK)]), F.translate(text, OPEN + CLOSE + BLANK, OTHER * 3)).otherwise(text)


def _blanked(df: DataFrame, name: str, pattern: str, least: int) -> DataFrame:
    """``left`` with the matches that are long enough replaced by as many blanks."""
    wrapped = F.regexp_replace("left", pattern, f"{OPEN}$0{CLOSE}")

    def part(p: Column, i: Column) -> Column:
        m = F.substring_index(p, CLOSE, 1)
        long_enough = (i > 0) & (F.length(_value(name, pattern, m)) >= least)
        rest = F.replace(p, F.lit(CLOSE), F.lit(""))
        return F.when(long_enough, F.concat(F.repeat(F.lit(BLANK), F.length(m)), F.substr(rest, F.length(m) + 1))).otherwise(rest)

    return df.withColumn("left", F.when(F.col("left").rlike(pattern), F.array_join(F.transform(F.split(wrapped, OPEN), part), "")).otherwise(F.col("left")))


def _spans(df: DataFrame, name: str, pattern: str, least: int, text: str = "text") -> DataFrame:
    """Adds ``name``: array of (start, end, text) of the matches that are long enough."""
    parts, found = f"_{name}_parts", f"_{name}_found"
    wrapped = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")
    df = df.withColumn(parts, F.when(F.col(text).rlike(pattern), F.split(wrapped, OPEN)))
    value = lambda m: _value(name, pattern, m)
    df = df.withColumn(
        found,
        F.transform(
            F.slice(parts, 2, F.size(parts)),
            lambda p: F.struct((F.length(p) - 1).alias("step"), F.substring_index(p, CLOSE, 1).alias("m")),
        ),
    )
    df = df.withColumn(found, F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / SLICE).cast("int")), lambda i: F.slice(found, i * SLICE + 1, SLICE)))
    offsets = F.aggregate(
        F.transform(found, lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + x["step"])),
        F.array(F.length(F.get(parts, F.lit(0)))),
        lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)),
    )
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def place(a: Column, x: Column) -> Column:
        span = F.struct(a["at"].alias("start"), (a["at"] + F.length(x["m"])).alias("end"), x["m"].alias("m"))
        more = F.when(F.length(value(x["m"])) >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct((a["at"] + x["step"]).alias("at"), more.alias("out"))

    placed = F.flatten(
        F.zip_with(
            found,
            F.slice(offsets, 1, F.size(found)),
            lambda s, at: F.aggregate(s, F.struct(at.alias("at"), empty.alias("out")), place, lambda a: a["out"]),
        )
    )
    return df.withColumn(name, F.coalesce(placed, empty)).drop(parts, found)


def _by_encoding(encoding: Column, index: int) -> Column:
    out = None
    for name, values in ENCODINGS.items():
        out = F.when(encoding == name, F.lit(values[index])) if out is None else out.when(encoding == name, F.lit(values[index]))
    return out


def _add(column: str, **fields) -> Column:
    """The array of structs ``column`` with fields computed from each struct as it was."""

    def more(c: Column) -> Column:
        out = c
        for name, of in fields.items():
            out = out.withField(name, of(c))
        return out

    return F.transform(column, more)


def _normal_below(z: Column) -> Column:
    """P(N(0, 1) <= z) for z <= 0, by a known polynomial in 1 / (1 + 0.2316419 |z|); good to 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly


def _far(z: Column) -> Column:
    """-2 ln of the chance of a normal deviate beyond z, upwards."""
    upper = F.when(z >= 0, _normal_below(-z)).otherwise(1 - _normal_below(z))
    return -2 * F.ln(F.greatest(F.lit(1e-300), upper))


def battery(df: DataFrame, name: str) -> DataFrame:
    """Adds n, far (Fisher's sum of the three tests) and its bin to the structs (m, code, ...) of the array ``name``.

    Two passes over a run: its values in order give sums, products of neighbours, values above the middle
    and changes of side; sorted, the squares of their counts.
    """
    zero = F.lit(0.0)
    df = df.withColumn(
        name,
        _add(
            name,
            n=lambda c: F.length(c["m"]).cast("double"),
            size=lambda c: F.length(_by_encoding(c["code"], 1)).cast("double"),
            x=lambda c: F.transform(F.split(c["m"], ""), lambda ch: F.call_function("locate", ch, _by_encoding(c["code"], 1)) - 1),
        ),
    )

    def walk(c: Column) -> Column:
        start = F.struct(zero.alias("sum"), zero.alias("squares"), zero.alias("products"), zero.alias("high"), zero.alias("changes"), F.lit(-1).alias("last"))

        def step(a: Column, x: Column) -> Column:
            high, was = 2 * x >= c["size"], 2 * a["last"] >= c["size"]
            return F.struct(
                (a["sum"] + x).alias("sum"),
                (a["squares"] + x * x).alias("squares"),
                F.when(a["last"] < 0, a["products"]).otherwise(a["products"] + x * a["last"]).alias("products"),
                F.when(high, a["high"] + 1).otherwise(a["high"]).alias("high"),
                F.when((a["last"] < 0) | (high != was), a["changes"] + 1).otherwise(a["changes"]).alias("changes"),
                x.alias("last"),
            )

        return F.aggregate(c["x"], start, step)

    def counts(c: Column) -> Column:
        step = lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1)).alias("run"), (a["sum"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(F.lit(1))).alias("sum"))
        return F.aggregate(F.array_sort(c["x"]), F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("sum")), step, lambda a: a["sum"].cast("double"))

    df = df.withColumn(name, _add(name, w=walk, counts=counts))
    df = df.withColumn(
        name,
        _add(
            name,
            spread=lambda c: c["w"]["squares"] - c["w"]["sum"] * c["w"]["sum"] / c["n"],
            # of (x - mean) (next x - mean): neighbours' sums lack the last and the first value
            serial=lambda c: c["w"]["products"] - c["w"]["sum"] / c["n"] * (2 * c["w"]["sum"] - F.get(c["x"], F.lit(0)) - c["w"]["last"]) + (c["n"] - 1) * F.pow(c["w"]["sum"] / c["n"], F.lit(2.0)),
            both=lambda c: 2 * c["w"]["high"] * (c["n"] - c["w"]["high"]),
            chi=lambda c: c["size"] / c["n"] * c["counts"] - c["n"],
        ),
    )
    df = df.withColumn(name, _add(name, z=lambda c: _deviates(c["n"], c["size"], c["chi"], c["w"]["changes"], c["both"], c["serial"], c["spread"])))
    df = df.withColumn(name, _add(name, far=lambda c: sum(_shares(c["z"]).values())))
    return df.withColumn(name, _add(name, bin=lambda c: _bin(c["far"])))


def _deviates(n: Column, size: Column, chi: Column, changes: Column, both: Column, serial: Column, spread: Column) -> Column:
    """A normal deviate of each test, as a struct."""
    zero, far = F.lit(0.0), 99.0  # where a run has one value only, or one side of the middle
    z_chi = (F.pow(F.greatest(zero, chi / (size - 1)), F.lit(1 / 3)) - (1 - 2 / (9 * (size - 1)))) / F.sqrt(2 / (9 * (size - 1)))
    z_runs = F.abs(F.coalesce(F.try_divide(changes - 1 - both / n, F.sqrt(F.greatest(zero, both * (both - n) / (n * n * (n - 1))))), F.lit(far)))
    z_serial = F.abs(F.when(spread > 1e-9, serial / spread).otherwise(F.lit(far)) * F.sqrt(n))
    return F.struct(z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"))


def _shares(z: Column) -> dict[str, Column]:
    """Each test's part of Fisher's sum."""
    # two-sided chances are twice those upwards, of at most 1
    two = lambda z: F.greatest(F.lit(0.0), _far(z) - 2 * math.log(2))
    return {"of_chi": _far(z["chi"]), "of_runs": two(z["runs"]), "of_serial": two(z["serial"])}


def _bin(far: Column) -> Column:
    return F.least(F.lit(BINS), F.ceil(far / STEP)).cast("int")


def _band(n: Column) -> Column:
    return F.coalesce(*[F.when(n >= LENGTHS[i], F.lit(i)) for i in range(len(LENGTHS) - 1, 0, -1)], F.lit(0))


def candidates(df: DataFrame) -> DataFrame:
    """``runs`` (start, end, m) to structs (start, end, stratum, bin)."""
    df = df.withColumn("runs", F.filter("runs", lambda c: c["m"].rlike("[0-9]") & c["m"].rlike("[A-Za-z]")))

    def encoding(m: Column) -> Column:
        out = None
        for name, (pattern, *_) in ENCODINGS.items():
            if pattern:
                out = F.when(m.rlike(pattern), F.lit(name)) if out is None else out.when(m.rlike(pattern), F.lit(name))
        return out.otherwise(F.lit("base64"))

    df = df.withColumn("runs", _add("runs", m=lambda c: F.translate(F.rtrim(c["m"], F.lit("=")), "-_", "+/")))
    df = df.withColumn("runs", _add("runs", code=lambda c: encoding(c["m"])))
    df = df.withColumn("runs", F.transform("runs", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(c["code"] == "hex", F.upper(c["m"])).otherwise(c["m"]).alias("m"), c["code"].alias("code"))))
    df = battery(df, "runs")
    return df.withColumn("runs", F.transform("runs", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.concat_ws("-", c["code"], _band(c["n"]).cast("string")).alias("stratum"), c["bin"].alias("bin"))))


def _other(alphabet: str) -> str:
    """Pattern of runs of characters outside ``alphabet``."""
    return f"[^{alphabet}]++"


def windows(df: DataFrame) -> DataFrame:
    """(code, m): every text's ``left`` written as runs, from its first to its last character; the last window may overlap the one before."""
    df = df.select(F.regexp_replace("left", RUN, "").alias("left")).withColumn("at", F.shiftrightunsigned(F.xxhash64(F.lit("at"), "left"), 1))
    squeezed = lambda name, text, by: F.regexp_replace(text, _other(ENCODINGS[name][1]), by)
    df = _once(df, base62=squeezed("base62", F.initcap("left"), ""), base64=squeezed("base64", F.col("left"), "/")).drop("left")
    df = _once(df, upper=F.upper("base62"))
    rows = F.array(*[F.struct(F.lit(name).alias("code"), (squeezed(name, F.col("upper"), "") if name in ("hex", "base32") else F.col(name)).alias("s")) for name in ENCODINGS])
    df = df.select("at", F.inline(rows))  # generators work out a row's values once, projections wherever they are used
    n, wanted = F.length("s"), F.element_at(F.array(*[F.lit(x - 2) for x in LENGTHS]), F.pmod(F.expr("at div 11"), F.lit(len(LENGTHS))).cast("int") + 1)
    fits = F.coalesce(*[F.when(n >= x - 2, F.lit(x - 2)) for x in reversed(LENGTHS)])
    df = df.select("code", F.inline(F.array(F.struct(F.col("s").cast("binary").alias("s"), n.alias("n"), F.least(wanted, fits).alias("w"), fits.alias("fits"))))).filter("fits IS NOT NULL")
    # all characters are ASCII: bytes are cut without counting from the start of the text
    last = F.when(F.col("n") % F.col("w") != 0, F.array(F.col("n") - F.col("w") + 1)).otherwise(F.array().cast("array<int>"))
    df = df.select("code", "s", "w", F.explode(F.concat(F.sequence(F.lit(1), F.col("n") - F.col("w") + 1, F.col("w")), last)).alias("i"))
    df = df.select("code", F.inline(F.array(F.struct(F.substr("s", F.col("i"), F.col("w")).cast("string").alias("m")))))
    digit = lambda k: F.substr(F.lit("234567"), F.pmod(F.expr(f"at div {k}"), F.lit(6)).cast("int") + 1, F.lit(1))
    df = df.withColumn("at", F.shiftrightunsigned(F.xxhash64("m"), 1))
    return df.select("code", F.concat("m", digit(7), digit(101)).alias("m"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """As ``withColumns``, but in code of their own: Spark joins plain projections into methods too long to be compiled."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def tested(df: DataFrame) -> DataFrame:
    """Adds n, far and bin to rows (code, m), m of at most 2 ``HALF`` characters: as ``battery``, by columns instead of array elements.

    A window is written in the alphabet of base64, filled up with its first character (value 0) and decoded, so that each
    ``GROUP`` characters are a number of ``BITS`` bits a character, x0 to x11. From those, bit i of all values is gathered in two numbers,
    a{i} of the first ``HALF`` characters and b{i} of the others: character k of group g is bit 6 (7 - k) + g. Sums are counts of bits;
    values of 0 that fill a window up add nothing to most of them. Counts are doubles, which hold them exactly: Spark checks each sum of integers for overflow, in a closure of its own.
    """
    both, k, groups = ("a", "b"), F.col("k"), HALF // GROUP
    bits = lambda x: F.bit_count(x).cast("double")
    two_to = lambda n: F.lit(float(1 << n))
    total = lambda some: reduce(lambda x, y: x + y, some)
    long = lambda v: F.lit(v).cast("long")
    full, standard = (1 << HALF) - 1, ENCODINGS["base64"][1]
    size = F.coalesce(*[F.when(F.col("code") == c, F.lit(float(len(v[1])))) for c, v in ENCODINGS.items()], F.lit(0.0))
    spelt = F.col("m")
    for c in ("hex", "base32"):
        moved = [(x, standard[i]) for i, x in enumerate(ENCODINGS[c][1]) if x != standard[i]]
        spelt = F.when(F.col("code") == c, F.translate("m", "".join(x for x, _ in moved), "".join(y for _, y in moved))).otherwise(spelt)
    df = _once(df, k=F.coalesce(F.length("m"), F.lit(0)), size=size, bytes=F.unbase64(F.rpad(F.coalesce(spelt, F.lit("")), 2 * HALF, standard[0]))).drop("m")
    per = GROUP * BITS // 8
    number = lambda g: F.conv(F.hex(F.substr("bytes", F.lit(per * g + 1), F.lit(per))), 16, 10).cast("long")
    df = _once(df, **{f"x{g}": F.coalesce(F.when(k > GROUP * g, number(g)), long(0)) for g in range(2 * groups)}, at=F.expr(f"{BITS} * ({GROUP - 1} - pmod(k - 1, {GROUP})) + pmod(k - 1, {HALF}) div {GROUP}").cast("int")).drop("bytes")
    every = sum(1 << BITS * j for j in range(GROUP))
    moved_by = lambda x, n: F.shiftleft(x, n) if n > 0 else F.shiftright(x, -n) if n else x
    for h, from_ in zip(both, (0, groups), strict=True):
        df = _once(df, **{f"{h}{i}": reduce(Column.bitwiseOR, [moved_by(F.col(f"x{from_ + g}").bitwiseAND(long(every << i)), g - i) for g in range(groups)]) for i in range(BITS)})
        df = df.drop(*[f"x{from_ + g}" for g in range(groups)])
    # counts of each value: the characters with its higher bits and with its lower ones
    three = lambda h, low, v: reduce(Column.bitwiseAND, [F.col(f"{h}{low + i}") if v >> i & 1 else F.bitwise_not(f"{h}{low + i}") for i in range(3)], long(full))
    for h in both:
        df = _once(df, **{f"{h}_{low}_{v}": three(h, low, v) for low in (0, 3) for v in range(8)})
    square = lambda x: x * x
    held = lambda h, x: x if h == "a" else F.when(k > HALF, x).otherwise(F.lit(0.0))
    filled = lambda v: [k.cast("double") - F.when(k > HALF, F.lit(2.0 * HALF)).otherwise(F.lit(float(HALF)))] if v == 0 else []
    count = lambda u, v: total([held(h, bits(F.col(f"{h}_3_{v}").bitwiseAND(F.col(f"{h}_0_{u}")))) for h in both] + filled(u + v))
    for v in range(0, 8, 2):
        df = _once(df, **{f"n{u}_{x}": count(u, x) for x in (v, v + 1) for u in range(8)})
        df = _once(df, **{f"counts_{v}": total(square(F.col(f"n{u}_{x}")) for x in (v, v + 1) for u in range(8))}).drop(*[f"n{u}_{x}" for x in (v, v + 1) for u in range(8)])
    df = df.drop(*[f"{h}_{low}_{v}" for h in both for low in (0, 3) for v in range(8)])
    # sums of values, squares and products of neighbours, bit by bit; next to a group's last character is the next group's first
    beyond = lambda i: F.shiftleft(F.shiftright(f"b{i}", HALF - BITS).bitwiseAND(long(1)), BITS - 1)
    after = lambda h, i: [F.shiftleft(f"{h}{i}", BITS).bitwiseAND(long(full)), F.shiftright(f"{h}{i}", HALF - BITS + 1)] + ([beyond(i)] if h == "a" else [])
    for h in both:
        df = _once(
            df,
            **{f"sum_{h}": total(two_to(i) * bits(F.col(f"{h}{i}")) for i in range(BITS))},
            **{f"squares_{h}": held(h, total(two_to(i + j + (i != j)) * bits(F.col(f"{h}{i}").bitwiseAND(F.col(f"{h}{j}"))) for i in range(BITS) for j in range(i, BITS)))},
            **{f"after_{h}{i}": reduce(Column.bitwiseOR, after(h, i)) for i in range(BITS)},
        )
        df = _once(df, **{f"products_{h}": held(h, total(two_to(i + j) * bits(F.col(f"{h}{i}").bitwiseAND(F.col(f"after_{h}{j}"))) for i in range(BITS) for j in range(BITS)))})
    # above the middle: the highest bit, and of 62 values the 32nd too
    top = lambda h: F.when(F.col("size") == 16, F.col(f"{h}3")).when(F.col("size") == 32, F.col(f"{h}4")).when(F.col("size") == 64, F.col(f"{h}5")).otherwise(F.col(f"{h}5").bitwiseOR(reduce(Column.bitwiseAND, [F.col(f"{h}{i}") for i in range(5)])))
    df = _once(df, a_top=top("a"), b_top=top("b"), after_a_top=top("after_a"), after_b_top=top("after_b"))
    one = lambda x: F.call_function("shiftright", x, F.col("at")).bitwiseAND(long(1))
    end = lambda i: F.when(k == 0, long(0)).otherwise(one(F.when(k > HALF, F.col(f"b{i}")).otherwise(F.col(f"a{i}"))))
    df = _once(df, ends=total(two_to(i) * (bits(end(i)) + bits(F.shiftright(f"a{i}", HALF - BITS).bitwiseAND(long(1)))) for i in range(BITS)), last_high=bits(end("_top")))
    found = {
        "high": total(bits(F.col(f"{h}_top")) for h in both), "changes": total(bits(F.col(f"{h}_top").bitwiseXOR(F.col(f"after_{h}_top"))) for h in both) + 1.0 - F.col("last_high"), "counts": total(F.col(f"counts_{v}") for v in range(0, 8, 2)),
        "sum": F.col("sum_a") + F.col("sum_b"), "squares": F.col("squares_a") + F.col("squares_b"), "products": F.col("products_a") + F.col("products_b"), "n": k, "ends": F.col("ends"),
    }
    df = _once(df.select("code", "size", *[x.cast("double").alias(f"w_{c}") for c, x in found.items()]), **{c: F.col(f"w_{c}") for c in found}).select("code", "size", *found)
    mean = F.col("sum") / F.col("n")
    serial = F.col("products") - mean * (2 * F.col("sum") - F.col("ends")) + (F.col("n") - 1) * F.pow(mean, F.lit(2.0))
    df = _once(df, spread=F.col("squares") - F.col("sum") * mean, serial=serial, both=2 * F.col("high") * (F.col("n") - F.col("high")), chi=F.col("size") / F.col("n") * F.col("counts") - F.col("n"))
    df = _once(df, z=_deviates(*map(F.col, ("n", "size", "chi", "changes", "both", "serial", "spread")))).select("code", "n", "z")
    for name, share in _shares(F.col("z")).items():
        df = _once(df, **{name: share})
    df = _once(df, far=F.col("of_chi") + F.col("of_runs") + F.col("of_serial"))
    return df.select("code", "n", "far", _bin(F.col("far")).alias("bin"))


def usual(df: DataFrame) -> DataFrame:
    """(stratum, bin, usual): the windows of ordinary text of each stratum and bin."""
    rows = tested(windows(df))
    return rows.groupBy(F.concat_ws("-", "code", _band(F.col("n")).cast("string")).alias("stratum"), "bin").agg(F.count("*").alias("usual"))


def _counted(scanned: DataFrame, column: str, name: str) -> DataFrame:
    return scanned.select(F.explode(column).alias("r")).groupBy(F.col("r.stratum").alias("stratum"), F.col("r.bin").alias("bin")).agg(F.count("*").alias(name))


def thresholds(scanned: DataFrame, ordinary: DataFrame | None = None) -> DataFrame:
    """(stratum, bin): the greatest bin that Benjamini-Hochberg rejects in each stratum with any.

    m counts all runs of the stratum, p the windows of ordinary text of a bin and below: ``ordinary`` (stratum, bin, usual), or those of the column ``usual``.
    """
    ordinary = _counted(scanned, "usual", "usual") if ordinary is None else ordinary
    both = _counted(scanned, "runs", "found").join(ordinary, ["stratum", "bin"], "full").fillna(0, ["found", "usual"])  # a row a stratum and bin at most
    own = Window.partitionBy("stratum")
    upto = own.orderBy("bin")
    rows = both.withColumns({"k": F.sum("found").over(upto), "m": F.sum("found").over(own), "closer": F.sum("usual").over(upto), "all": F.sum("usual").over(own)})
    right = rows.filter((F.col("found") > 0) & ((1 + F.col("closer")) / (1 + F.col("all")) <= FDR * F.col("k") / F.col("m")))
    return right.groupBy("stratum").agg(F.max("bin").alias("bin"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.sort_array(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _left(df: DataFrame) -> DataFrame:
    """``text`` to ``left``: what base spans leave of it, kind after kind."""
    df = df.withColumn("left", F.col("text")).drop("text")
    for kind in KINDS:
        df = _blanked(df, *kind)
    return df


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row of ``docs`` (doc_id, text)."""
    df = plain = docs.select("doc_id", _unmarked(F.coalesce("text", F.lit(""))).alias("text"))
    for kind in KINDS:
        df = _spans(df, *kind)
    df = _left(df)
    df = _spans(df, "runs", RUN, 20, "left")

    def named(name: str, place: int) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(name if name != "runs" else "random").alias("kind"), s["end"].alias("end")))

    df = df.withColumn("base", F.concat(*[named(k, i) for i, (k, _, _) in enumerate(KINDS)]))
    df = df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, _, _ in KINDS], "base", "runs")
    scanned = common.written(candidates(df), "secret-spans")
    limits = {r["stratum"]: r["bin"] for r in thresholds(scanned, usual(_left(plain))).collect()}  # at most an entry a stratum
    passes = lambda r: sum([((r["stratum"] == s) & (r["bin"] <= b)).cast("int") for s, b in sorted(limits.items())], F.lit(0)) > 0
    return scanned.withColumn("runs", F.filter("runs", passes)).select(
        "doc_id", *[f"n_{k}" for k, _, _ in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", named("runs", len(KINDS)))).alias("spans"), F.size("runs").cast("long").alias("n_random")
    )
