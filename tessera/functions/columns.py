"""Column functions: text, JSON repair, token arrays, deterministic draws. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *keys: Column) -> Column:
    """32 hex digits that depend only on the seed and the keys: the engine's source of randomness."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def draw_int(seed: int, n: int | Column, *keys: Column) -> Column:
    """An integer in [0, n) from the first seven digits of :func:`draw`."""
    return F.pmod(F.conv(F.substring(draw(seed, *keys), 1, 7), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def pick(options: list[str], seed: int, *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (draw_int(seed, len(options), *keys) + 1).cast("int"))


def skewed_high(low: int, high: int, unit: Column) -> Column:
    """A triangular draw with its mode at the upper end, floored."""
    return F.floor(low + (high - low) * F.sqrt(unit))


def content_length(question: Column, answer: Column | None = None) -> Column:
    """Code points of the longer side; a missing side counts as empty."""
    q = F.length(F.coalesce(question, F.lit("")))
    return q if answer is None else F.greatest(q, F.length(F.coalesce(answer, F.lit(""))))


def minify(x: Column) -> Column:
    """Outer white space, line feeds and double spaces go, inside values too."""
    return F.replace(F.replace(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("\n"), F.lit("")), F.lit("  "), F.lit(""))


def xml_escape(x: Column) -> Column:
    out = F.replace(x, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_text(x: Column) -> Column:
    """A scalar as element text: null is empty, booleans are lower case."""
    return xml_escape(F.coalesce(x.cast("string"), F.lit("")))


def with_declaration(x: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n'), x)


def context_prefix(context: Column, question: Column) -> Column:
    return F.concat_ws(" ", context, question)


def instruct_prompt(context: Column, question: Column) -> Column:
    """Instruction and context sections; an empty question has no context section."""
    head = F.concat(F.lit("### Instruction:\n"), context, F.lit("\n"))
    return F.when(F.coalesce(question, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("### Context:\n"), question, F.lit("\n")))


def pad_truncate(ids: Column, length: int, pad: int = 0) -> Column:
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(cut))))


def attention_mask(ids: Column, length: int) -> Column:
    ones = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), length - ones))


def mask_labels(ids: Column, pad: int = 0, ignore: int = -100) -> Column:
    return F.transform(ids, lambda t: F.when(t == pad, ignore).otherwise(t))


def unmask_labels(ids: Column, pad: int = 0, ignore: int = -100) -> Column:
    return F.transform(ids, lambda t: F.when(t == ignore, pad).otherwise(t))


def clip_ids(ids: Column, vocabulary: int) -> Column:
    return F.transform(ids, lambda t: F.greatest(F.lit(0), F.least(F.lit(vocabulary - 1), t)))


def prefix_keys(m: Column, prefix: str = "@") -> Column:
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k))


def tag_counts(x: Column) -> Column:
    """Names of start tags in document order."""
    return F.regexp_extract_all(x, F.lit(r"<([a-zA-Z][\w.:-]*)"), F.lit(1))


_NAME = r"[\w.:-]+"
#: A string, or a part of one that never ends; without backtracking, as strings may be long.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: What repair reads a text as: an attribute, a string, a bare word before a key, or any character.
_PIECES = rf'(?Us){_NAME}\s*+=\s*+"[^"]*+"|{_STRING}|(?<!["\w]){_NAME}\s++(?="{_NAME}":)|.'


def balance(marks: Column) -> Column:
    """Closers for the brackets that a list of single brackets leaves open, innermost first; unmatched closers are ignored."""

    def step(held, c):
        closes = ((c == "}") & F.endswith(held, F.lit("{"))) | ((c == "]") & F.endswith(held, F.lit("[")))
        return F.when(c.isin("{", "["), F.concat(held, c)).when(closes, F.left(held, F.length(held) - 1)).otherwise(held)

    return F.translate(F.reverse(F.aggregate(marks, F.lit(""), step)), "{[", "}]")


def mended(x: Column) -> Column:
    """``x`` with JSON's rules applied, whether or not it parses then.

    One reading of the text splits it into pieces, strings being one each, so nothing inside a string is
    touched: attributes become members, a bare word before a key the key of an object, trailing tag ends go, as do commas before a
    closer, and open brackets are closed.
    """
    cut = F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)[/>]+$|[/>]+\s*$", "")
    pieces = F.regexp_extract_all(cut, F.lit(f"({_PIECES})"), F.lit(1))

    def piece(t):
        attribute = F.regexp_replace(t, rf'(?Us)^({_NAME})\s*=\s*(".*)$', r'"$1": $2,')
        word = F.regexp_replace(t, rf"(?U)^({_NAME})\s+$", r'"$1": { ')
        return F.when(t.startswith('"'), t).when(t == ",", t).when(F.length(t) == 1, t).when(t.contains("="), attribute).otherwise(word)

    def closed(parts):
        marks = F.filter(parts, lambda t: t.isin("{", "}", "[", "]") | (t.endswith('": { ') & ~t.startswith("{")))
        return F.concat(F.array_join(parts, ""), balance(F.transform(marks, lambda t: F.substring(F.trim(t), -1, 1))))

    made = F.get(F.transform(F.array(F.transform(pieces, piece)), closed), 0)
    return F.regexp_replace(made, rf"(?s)({_STRING})|,(?=\s*[}}\]])", "$1")


def repair_json(x: Column) -> Column:
    """JSON text mended by rule - see :func:`mended` - or null if it still doesn't parse; what parses stays as it is."""
    checked = F.get(F.transform(F.array(mended(x)), lambda m: F.when(parses(m), m)), 0)
    return F.when(parses(x), x).otherwise(checked)


def parses(x: Column) -> Column:
    """The whole text is JSON; the parser alone would overlook what follows a value."""
    return F.try_parse_json(x).isNotNull() & x.rlike(r'(?s)[}\]"\w]\s*$')


def greedy_groups(lines: Column, budget: int) -> Column:
    """Group number of each line: a running sum that starts anew when the next line would pass the budget.

    The fold keeps the places where groups start, not a number for every line.
    """
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("used"))

    def step(a, line):
        n = F.length(line)
        fresh = (a["used"] > 0) & (a["used"] + n > budget)
        starts = F.when(fresh, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"])
        return F.struct(starts.alias("starts"), (a["i"] + 1).alias("i"), F.when(fresh, n).otherwise(a["used"] + n).alias("used"))

    def numbered(a):
        ends = F.concat(F.slice(a["starts"], 2, F.size(a["starts"])), F.array(a["i"]))
        return F.flatten(F.zip_with(F.transform(a["starts"], lambda s, g: F.struct(s.alias("s"), g.alias("g"))), ends, lambda x, e: F.array_repeat(x["g"], e - x["s"])))

    return F.aggregate(lines, start, step, numbered)


def left(x: Column, n: int = 20) -> Column:
    """The first ``n`` code points."""
    return F.left(x, F.lit(n))


def prefix_name(seed: int, *keys: Column) -> Column:
    """Eight characters of a digest after a letter, so that it is a valid XML name."""
    return F.concat(F.lit("u"), F.left(draw(seed, *keys), F.lit(7)))


def merged_map(a: Column, b: Column) -> Column:
    """Both maps' entries, those of ``b`` in place of equal keys of ``a``, whatever the session says of repeated keys."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def promoted_values(values: Column) -> Column:
    """JSON of what was collected under one key: one value as it is, more as a list; lists among them are taken apart."""
    parts = F.filter(F.flatten(F.transform(values, lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))), lambda v: v.isNotNull())
    return F.when(F.size(values) == 1, F.get(values, 0)).otherwise(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))


def coerced(x: Column) -> Column:
    """JSON text of a scalar's text: true and false, null where it is empty, a whole number, else a string."""
    number, quoted = x.try_cast("long"), F.to_json(F.array(x))
    text = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    return F.when(F.coalesce(x, F.lit("")) == "", "null").when(x.isin("true", "false"), x).when(number.isNotNull() & x.rlike(r"^\s*[+-]?[0-9]+\s*$"), number.cast("string")).otherwise(text)


def token_strings(x: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def token_count(x: Column, count=F.length) -> Column:
    """Tokens of a text by a pluggable function of a column; code points where none is given. Null counts as empty."""
    return count(F.coalesce(x, F.lit("")))


def in_turn(options: list[str], i: Column) -> Column:
    """The options one after the other."""
    return F.get(F.array(*map(F.lit, options)), F.pmod(i, F.lit(len(options))).cast("int"))
