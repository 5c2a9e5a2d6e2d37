"""Text functions: Column -> Column, all inside code generation. A miss is null unless said otherwise.

Helpers of one purpose differ on purpose where answers come from different writers; each variant has its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.frames import let

# Fixed values.
CLOCK = r"\d{1,2}:\d{2}(?:\.\d{1,3})?"
PLACE_WORDS = (
    "left lane", "right lane", "left side", "right side", "crosswalk", "intersection", "sidewalk", "shoulder",
    "median", "turn lane", "opposite lane", "oncoming lane", "bottom of the frame", "top of the frame",
)
HEDGES = ("somehow", "probably", "appears to", "seems to", "might be", "likely", "in general", "typically")
QUIET = ("no anomaly", "no accident", "no collision", "no incident", "normal traffic", "uneventful", "no unusual")
EVENTS = ("collide", "crash", "accident", "violat", "hits", "loses control")
FORMAT_PHRASES = r"Answer with|Provide the result|Provide the"
PAIR_PHRASES = r"Answer with|Provide|Choose"
LETTERS = ("A", "B", "C", "D")


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end (not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def find(c: Column, pattern: str, group: int = 1) -> Column:
    return blank_null(F.regexp_extract(c, pattern, group))


def any_of(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


# --- counts

def count_pattern(c: Column, pattern: str = CLOCK) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def count_words_in(c: Column, words=PLACE_WORDS) -> Column:
    """Occurrences of all words as substrings; those of different words may overlap."""
    low, total = F.lower(c), F.lit(0)
    for w in words:
        total = total + (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    return total.cast("long")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")).cast("long")


def hedge_ratio(c: Column, words=HEDGES) -> Column:
    n = word_count(c)
    return F.when(n == 0, F.lit(1.0)).otherwise(count_words_in(c, words).cast("double") / n)


def long_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


# --- answers

def _tagged(c: Column, tag: str) -> Column:
    """(found, content) of a tag's first pair."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.struct(F.regexp_like(c, F.lit(pattern)).alias("on"), F.regexp_extract(c, pattern, 1).alias("s"))


def unwrap_then_unthink(c: Column) -> Column:
    t = _tagged(text(c), "answer")
    return strip(F.regexp_replace(F.when(t["on"], t["s"]).otherwise(text(c)), "(?s)<think>.*?</think>", ""))


def unwrap_or_whole(c: Column) -> Column:
    t = _tagged(text(c), "answer")
    return strip(F.when(t["on"], t["s"]).otherwise(text(c)))


def unwrap_or_unthink(c: Column) -> Column:
    """Also drops all before a closing think tag that was never opened."""
    t = _tagged(text(c), "answer")
    rest = F.regexp_replace(F.regexp_replace(text(c), "(?s)<think>.*?</think>", ""), "(?s)\\A.*?</think>", "")
    return strip(F.when(t["on"], t["s"]).otherwise(rest))


def unwrap_external(think: Column, answer: Column) -> Column:
    """struct(reasoning, answer): the think tag's content or '', the answer tag's or the raw answer."""
    t, a = _tagged(text(think), "think"), _tagged(text(answer), "answer")
    return F.struct(strip(F.when(t["on"], t["s"]).otherwise(F.lit(""))).alias("reasoning"), strip(F.when(a["on"], a["s"]).otherwise(text(answer))).alias("answer"))


def prefix_polarity(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(F.startswith(low, F.lit("yes")), "yes").when(F.startswith(low, F.lit("no")), "no")


def true_polarity(c: Column) -> Column:
    return F.when(F.startswith(F.lower(strip(text(c))), F.lit("yes")), "yes").otherwise("no")


def yes_no(c: Column) -> Column:
    return find(F.lower(text(c)), r"\b(yes|no)\b")


def implies_event(c: Column) -> Column:
    """False if a quiet phrase occurs, else true if an event word does, else undecided."""
    low = F.lower(c)
    return F.when(any_of(low, QUIET), False).when(any_of(low, EVENTS), True)


def verdict(c: Column) -> Column:
    low = F.lower(strip(text(c)))
    return F.when(F.regexp_like(low, F.lit(r"\bunknown\b|\bunclear\b|\bcannot\b|\bnot determin")), "unknown").otherwise(F.coalesce(yes_no(low), F.lit("unknown")))


def letter_leading(c: Column) -> Column:
    s = strip(text(c))
    return F.coalesce(F.upper(find(s, r"\A\(?([A-Za-z])\)?[).\s,:]")), F.upper(find(s, r"\A([A-Da-d])\z")), find(s, r"\b([A-D])\b"))


def letter_standalone(c: Column) -> Column:
    return find(F.upper(text(c)), r"\b([A-D])\b")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def flipped(c: Column) -> Column:
    return F.when(F.lower(strip(c)) == "yes", "No").otherwise("Yes")


# --- questions

def cut_at(c: Column, phrases: str) -> Column:
    return F.element_at(F.split(text(c), phrases, 2), 1)


def cut_format(c: Column) -> Column:
    return strip(cut_at(c, FORMAT_PHRASES))


def first_line(c: Column) -> Column:
    return strip(F.element_at(F.split(text(c), "\n", 2), 1))


def plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")


def normal_option(c: Column) -> Column:
    return F.substring(plain(c), 1, 55)


def stem(c: Column) -> Column:
    return plain(first_line(c))


def pair_stem(c: Column) -> Column:
    return stem(cut_at(c, PAIR_PHRASES))


def _listed_option(q: Column, letter: Column, head: str, tail: str) -> Column:
    want = F.substring(F.upper(strip(text(letter))), 1, 1)
    names = F.regexp_extract_all(q, F.lit(f"(?s){head}\\s*(.+?)(?={tail}|\\z)"), F.lit(1))
    texts = F.regexp_extract_all(q, F.lit(f"(?s){head}\\s*(.+?)(?={tail}|\\z)"), F.lit(2))
    hit = F.array_position(names, want)
    return F.when(hit > 0, F.substring(squeeze(F.try_element_at(texts, hit.cast("int"))), 1, 220)).otherwise("")


def option_text(q: Column, letter: Column) -> Column:
    """Text of an A-E option written `A.` or `A)` at a line's start; '' if there is none."""
    return _listed_option(text(q), letter, r"(?:^|\n)\s*([A-E])[.)]", r"\n\s*[A-E][.)]")


def option_text_bracket(q: Column, letter: Column) -> Column:
    """Only the form `A)`, anywhere."""
    return _listed_option(text(q), letter, r"\b([A-E])\)", r"\n\s*[A-E]\)")


def option_line(q: Column, letter: Column) -> Column:
    """The rest of the line that starts with this one- or two-character letter."""
    l = strip(text(letter))
    pattern = F.concat(F.lit(r"(?md)^\s*\Q"), l, F.lit(r"\E[.)]\s*(.+)$"))
    return F.when((F.length(l) > 0) & (F.length(l) <= 2), blank_null(F.call_function("regexp_extract", text(q), pattern, F.lit(1))))


MARK = r"(?md)^\s*([A-D])[.)]\s+"


def options(q: Column) -> Column:
    """struct(A, B, C, D), or null unless exactly these four are listed; of a repeated letter the last counts."""

    def marked(tail: Column) -> Column:
        bodies = F.slice(F.split(tail, MARK), 2, 1 << 20)
        return F.zip_with(F.regexp_extract_all(tail, F.lit(MARK), F.lit(1)), bodies, lambda n, b: F.struct(n.alias("n"), b.alias("b")))

    def last_of(both: Column, letter: str) -> Column:
        b = F.try_element_at(F.filter(both, lambda x: x["n"] == letter), F.lit(-1))["b"]
        return b if letter != LETTERS[-1] else F.element_at(F.split(b, r"\n\s*\n|\bChoose the correct\b|\bAnswer with\b", 2), 1)

    def whole(last: Column) -> Column:
        tidy = F.struct(*(strip(F.regexp_replace(squeeze(last[l]), r"\?+$", "")).alias(l) for l in LETTERS))
        return F.when(last["A"].isNotNull() & last["B"].isNotNull() & last["C"].isNotNull() & last["D"].isNotNull(), tidy)

    listed = let(let(F.regexp_extract(text(q), r"(?sm)^\s*A[.)]\s.*\z", 0), marked), lambda both: F.struct(*(last_of(both, l).alias(l) for l in LETTERS)))
    return let(listed, whole)


DEFAULT_ORDER = "Choose the correct option."


def question_parts(q: Column) -> Column:
    """struct(stem, options, order): the text before the options, the options, the instruction line."""
    head = F.element_at(F.split(text(q), r"(?md)^\s*A[.)]\s", 2), 1)
    return F.struct(strip(head).alias("stem"), options(q).alias("options"), F.coalesce(find(text(q), r"(?md)^\s*((?:Choose|Answer with)[^\n]*)$"), F.lit(DEFAULT_ORDER)).alias("order"))


def option_array(o: Column) -> Column:
    return let(o, lambda v: F.when(v.isNotNull(), F.array(*(v[l] for l in LETTERS))))


def normal_options(o: Column) -> Column:
    return F.transform(option_array(o), normal_option)


def permuted_question(stem_: Column, o: Column, order: Column, perm: list[int]) -> Column:
    rows = [F.concat(F.lit(f"{l}. "), F.element_at(option_array(o), p + 1)) for l, p in zip(LETTERS, perm)]
    return F.concat_ws("\n", stem_, *rows, order)


def permuted_pick(o: Column, letter: Column, perm: list[int]) -> Column:
    """The normal text of the option that a letter means in a permuted question."""
    out = F.lit(None).cast("string")
    for l, p in zip(LETTERS, perm):
        out = F.when(letter == l, normal_option(F.element_at(option_array(o), p + 1))).otherwise(out)
    return out


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text(c)), "[^a-z0-9 ]", " "), " +"), lambda x: x != ""))


def best_option(chosen: Column, o: Column) -> Column:
    """The letter whose text shares most with `chosen` by Jaccard; the first among equals; null if none shares."""
    want = token_set(chosen)
    scored = F.array(*(F.struct(jaccard(want, token_set(o[l])).alias("s"), F.lit(-k).alias("k"), F.lit(l).alias("l")) for k, l in enumerate(LETTERS)))
    top = F.array_max(scored)
    return F.when(top["s"] > 0, top["l"])


def letter_of(o: Column, normal: Column) -> Column:
    """The first letter whose normal text is this."""
    out = F.lit(None).cast("string")
    for l in reversed(LETTERS):
        out = F.when(normal_option(o[l]) == normal, l).otherwise(out)
    return out


# --- names and targets

def slug(path: Column, question: Column) -> Column:
    safe = F.replace(F.replace(F.replace(path, F.lit("/"), F.lit("__")), F.lit(".mp4"), F.lit("")), F.lit(".avi"), F.lit(""))
    return F.concat(safe, F.lit("__"), F.substring(F.md5(F.concat(path, question).cast("binary")), 1, 8))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def thought_answer(reasoning: Column, answer: Column) -> Column:
    # Fixed value: a training format.
    return F.concat(F.lit("<think>"), text(reasoning), F.lit("</think>\n<answer>"), text(answer), F.lit("</answer>"))


def ascii_string(c: Column) -> Column:
    """A text as a JSON string of ASCII characters, others as \\u and four hexadecimal digits (two such above U+FFFF)."""
    quoted = F.regexp_extract(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", 1)
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def written(x: Column) -> Column:
        code = F.ascii(x).cast("long")
        pair = F.concat(four(F.lit(0xD800).cast("long") + F.shiftright(code - 0x10000, 10)), four(F.lit(0xDC00).cast("long") + (code - 0x10000).bitwiseAND(F.lit(0x3FF).cast("long"))))
        return F.when(code < 128, x).when(code < 0x10000, four(code)).otherwise(pair)

    plain = F.regexp_like(quoted, F.lit(r"\A[\x00-\x7f]*\z"))
    return F.when(plain, quoted).otherwise(F.array_join(F.transform(F.regexp_extract_all(quoted, F.lit("(?s)."), F.lit(0)), written), ""))


def python_number(c: Column) -> Column:
    """The text of a JSON number as Python writes the number it reads: whole numbers as they stand, others shortest,
    without an exponent from 1e-4 up to 1e16."""
    value = F.abs(c.cast("double"))
    # Java before 19 writes some numbers with a digit more than they need: sixteen digits are tried.
    sixteen = F.format_string("%.15e", value)
    java = F.when((F.length(F.regexp_replace(value.cast("string"), r"E.*|\D", "")) > 16) & (sixteen.cast("double") == value), F.regexp_replace(sixteen, r"0*e\+?(-?)0*(\d+)$", "E$1$2")).otherwise(value.cast("string"))
    sign = F.when(F.startswith(c, F.lit("-")), "-").otherwise("")
    parts = F.regexp_extract_all(java, F.lit(r"[0-9]+|E-?[0-9]+"), F.lit(0))

    def shaped(p: Column) -> Column:
        exponent = F.substring(F.get(p, F.lit(2)), 2, 9).cast("int")
        rest = F.when(F.get(p, F.lit(1)) == "0", "").otherwise(F.get(p, F.lit(1)))
        digits = F.concat(F.get(p, F.lit(0)), rest)
        long = F.rpad(digits, 17, "0")
        tail = F.regexp_replace(F.substr(long, exponent + 2), "0+$", "")
        large = F.concat(F.substr(long, F.lit(1), exponent + 1), F.lit("."), F.when(tail == "", "0").otherwise(tail))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        power = F.concat(F.get(p, F.lit(0)), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        power = F.when(F.abs(exponent) > 99, F.regexp_replace(power, r"e([+-])\d\d$", F.concat(F.lit("e$1"), F.abs(exponent).cast("string")))).otherwise(power)
        return F.when(exponent.isNull(), java).when(exponent.between(0, 15), large).when(exponent.between(-4, -1), small).otherwise(power)

    whole = F.when(F.regexp_like(c, F.lit(r"\A-0+\z")), "0").otherwise(c)
    special = F.when(F.startswith(java, F.lit("Inf")), "Infinity")
    return F.when(~F.regexp_like(c, F.lit("[.eE]")), whole).otherwise(F.concat(sign, F.coalesce(special, let(parts, shaped))))


def json_spaced(c: Column) -> Column:
    """JSON written anew: one space behind commas and colons and none elsewhere, strings in ASCII, numbers as Python has them."""
    tokens = F.regexp_extract_all(c, F.lit(r'(?s)("(?:[^"\\]|\\.)*"|[^\s",:{}\[\]]+|[,:{}\[\]])'), F.lit(1))

    def again(x: Column) -> Column:
        said = F.get_json_object(F.concat(F.lit('{"s":'), x, F.lit("}")), "$.s")
        number = F.regexp_like(x, F.lit(r"\A-?[0-9]"))
        return F.when(x.isin(",", ":"), F.concat(x, F.lit(" "))).when(F.startswith(x, F.lit('"')), F.coalesce(ascii_string(said), x)).when(number, python_number(x)).otherwise(x)

    return F.array_join(F.transform(tokens, again), "")


def target(task: Column, reasoning: Column, answer: Column, with_thought: bool) -> Column:
    """The training target; an interval answer is written anew as JSON, a thought only if asked for and there."""
    a = F.when(task == "temporal_localization", json_spaced(answer)).otherwise(text(answer))
    return F.when(F.lit(with_thought) & (text(reasoning) != ""), thought_answer(reasoning, a)).otherwise(a)
