"""Cleaning, splitting and tokenising as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element names taken as markup; anything else in angle brackets is text.
HTML_TAGS = (
    "html head body title meta link base style script noscript div span p br hr pre code kbd samp var blockquote "
    "h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption colgroup col a img figure figcaption "
    "picture source b i u s strong em mark small sub sup del ins abbr cite q form input button select option optgroup "
    "textarea label fieldset legend nav header footer main section article aside details summary dialog iframe embed "
    "object param video audio track canvas svg path g font center big strike tt o:p xml"
).split()

#: Endings that a Korean token may carry, in the groups of verbs, particles of two or more letters, and of one.
SUFFIXES = (
    "하려면 하려고 하는법 합니까 습니다 하나요 할까요 해줘 해주세요 하기 하는 해서 하고 한다 했다 됩니다 입니다 이에요 예요 "
    "에서는 에서의 으로는 에게서 께서는 이라는 라는 부터 까지 에서 으로 로서 로써 에게 한테 께서 이나 거나 이랑 "
    "은 는 이 가 을 를 의 에 도 만 과 와 로 야 요"
).split()

#: The patterns that the required output of cleaning forces.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
TAG = r"(?i)</?(?:" + "|".join(HTML_TAGS) + r")\b[^>]*/?>"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]+)\]\([^)]*\)"
URL = r"https?://\S+"
HEADER = r"^#{1,6}\s+"
#: The white space at line ends that is stripped: ASCII and the no-break space.
EDGE = r"^[ \t\r\x0b\x0c\x{a0}]+|[ \t\r\x0b\x0c\x{a0}]+$"
TOKEN = r"[0-9A-Za-z가-힣_.-]+"


def strip_controls(t: Column) -> Column:
    """No control characters but tab, line feed and return; no-break spaces as spaces; no zero-width spaces."""
    return F.regexp_replace(F.translate(t, "\u00a0\u200b", " "), CONTROL, "")


def strip_markup(t: Column) -> Column:
    """Comments, then script and style blocks, then known tags become a space each; other angle brackets stay."""
    for p in (COMMENT, SCRIPT, STYLE, TAG):
        t = F.regexp_replace(t, p, " ")
    return t


#: The entities that the native expression knows; the Python function knows all.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape_common(t: Column) -> Column:
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def strip_links(t: Column) -> Column:
    """Images go; links become their text."""
    return F.regexp_replace(F.regexp_replace(t, IMAGE, ""), LINK, "$1")


def drop_urls(t: Column) -> Column:
    return F.regexp_replace(t, URL, "")


def collapse(t: Column) -> Column:
    """One space for runs of spaces and tabs, lines stripped, at most one empty line between, ends stripped."""
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, EDGE, "")), "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_native(t: Column, urls: bool = False) -> Column:
    """All cleaning steps that are expressions; Unicode normalisation, rare entities and code are left to ``clean_text``."""
    t = strip_links(F.translate(unescape_common(strip_markup(strip_controls(t))), "\u00a0", " "))
    return collapse(drop_urls(t) if urls else t)


def paragraphs(t: Column) -> Column:
    return F.filter(F.split(t, r"\n\s*\n", -1), lambda p: F.length(F.regexp_replace(p, r"\s+", "")) > 0)


def sections(t: Column) -> Column:
    """(title, body) of each section under a header line; a header that no line follows goes with its title.

    Header lines are found first; a body is the slice between two of them, so
    that the cost is linear in the lines and no list grows line by line.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"\n$", ""), "\n", -1)

    def cut(own: Column) -> Column:
        heads = F.filter(F.transform(own, lambda x, i: F.when(x.rlike(HEADER), i + 1)), lambda i: i.isNotNull())
        # what stands before the first header has no title; each section ends where the next begins
        starts, ends = F.concat(F.array(F.lit(0)), heads), F.concat(heads, F.array(F.size(own) + 1))
        bounds = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda b: b["z"] - b["a"] > 1)
        title = lambda a: F.when(a > 0, F.btrim(F.regexp_replace(F.get(own, a - 1), HEADER, ""), F.lit(" \t")))
        return F.transform(bounds, lambda b: F.struct(title(b["a"]).alias("title"), F.array_join(F.slice(own, b["a"] + 1, b["z"] - b["a"] - 1), "\n").alias("body")))

    # a lambda's body is evaluated for each element, so the lines are bound to an outer variable first
    return F.flatten(F.transform(F.array(lines), cut))


def hard_cut(t: Column, size: int) -> Column:
    """Pieces of ``size`` characters, the last shorter; one empty piece for an empty text."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(t) / size).cast("int") - 1)), lambda i: F.substr(t, i * size + 1, F.lit(size)))


def packed(t: Column, size: int, overlap: int) -> Column:
    """Pieces of whole paragraphs up to ``size``, longer ones cut hard, each with the end of the one before it; ``udfs.pack_paragraphs`` as an expression."""
    t = F.coalesce(t, F.lit(""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def add(a: Column, p: Column) -> Column:
        last = a["last"]
        fits = (last != "") & (F.length(last) + F.length(p) + 2 <= size)
        own = F.when(fits, F.concat(last, F.lit("\n\n"), p)).otherwise(p)
        return F.struct(F.when(fits | (F.coalesce(last, F.lit("")) == ""), a["done"]).otherwise(F.concat(a["done"], F.array(last))).alias("done"), own.alias("last"))

    whole = F.aggregate(F.split(t, "\n\n", -1), start, add, lambda a: F.concat(a["done"], F.array(a["last"])))
    cut = F.when(F.length(t) <= size, F.array(t)).otherwise(F.flatten(F.transform(F.filter(whole, lambda p: p != ""), lambda p: hard_cut(p, size))))
    if overlap <= 0:
        return cut

    def after(before: Column, own: Column) -> Column:
        tail = F.right(before, F.lit(overlap))
        at = F.instr(tail, " ")
        return F.concat(F.when((at > 0) & (at < F.length(tail)), F.substr(tail, at + 1)).otherwise(tail), F.lit("\n"), own)

    # the pieces are bound to an outer variable, as each looks at the one before it
    return F.flatten(F.transform(F.array(cut), lambda c: F.transform(c, lambda own, i: F.when(i == 0, own).otherwise(after(F.get(c, i - 1), own)))))


def clip(t: Column, n: int, marker: str = "…") -> Column:
    """The first ``n`` characters and the marker where the text is longer; 0 or less: no clipping."""
    return t if n <= 0 else F.when(F.length(t) > n, F.concat(F.substr(t, F.lit(1), F.lit(n)), F.lit(marker))).otherwise(t)


def context_prefix(text: Column, *parts: Column) -> Column:
    """"a > b > c" and a line feed before the text; null and empty parts are skipped."""
    head = F.concat_ws(" > ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n"), text))


def labelled_cells(*cells: tuple[str, Column]) -> Column:
    """"name: value" lines of the cells that are not blank."""
    line = lambda name, c: F.when(F.length(F.btrim(c.cast("string"), F.lit(" \t\n\r"))) > 0, F.concat(F.lit(f"{name}: "), F.btrim(c.cast("string"), F.lit(" \t\n\r"))))
    return F.concat_ws("\n", *[line(n, c) for n, c in cells])


def strip_suffix(token: Column) -> Column:
    """The longest known ending goes, once, if two characters or more stay: the shortest start before an ending."""
    return F.regexp_replace(token, "^(..+?)(?:" + "|".join(SUFFIXES) + ")$", "$1")


def distinct_folded(tokens: Column) -> Column:
    """Tokens without those that repeat an earlier one but for case; the first form stays.

    Sorted by folded form and place, so that long texts cost n log n; the
    sorted list is bound to an outer variable, since a lambda's body is
    evaluated for each element.
    """
    placed = F.sort_array(F.transform(tokens, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("t"))))
    first = F.flatten(F.transform(F.array(placed), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["low"] != x["low"]))))
    return F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))), lambda x: x["t"])


def tokens(query: Column) -> Column:
    """Search tokens: each as written, then without its ending; two characters or more, in order, no repeats."""
    raw = F.array_distinct(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)))
    both = F.flatten(F.transform(raw, lambda x: F.array(x, strip_suffix(x))))
    # all endings are Hangul; without it a token is its own stem
    return distinct_folded(F.filter(F.when(query.rlike("[가-힣]"), both).otherwise(raw), lambda x: F.length(x) >= 2))


def prefixes(query: Column) -> Column:
    """Prefix terms: tokens without unsafe characters, two characters or more."""
    safe = F.transform(tokens(query), lambda x: F.regexp_replace(x, "[^0-9A-Za-z가-힣_]", ""))
    return F.filter(safe, lambda x: F.length(x) >= 2)


def expansions(query: Column, most: int = 3) -> Column:
    """The query, its tokens joined, and those that are not numbers; no repeats, ``most`` at most."""
    t = tokens(query)
    words = F.filter(t, lambda x: ~x.rlike(r"^[0-9]+$"))
    all_ = F.filter(F.array(F.btrim(query), F.array_join(t, " "), F.array_join(words, " ")), lambda x: F.length(x) > 0)
    return F.slice(distinct_folded(all_), 1, most)


def lexemes(t: Column) -> Column:
    """Lower-case word tokens, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("([0-9a-z가-힣_]+)"), F.lit(1))


def fence_length(t: Column) -> Column:
    """A fence longer than any run of backticks in the text; three at least."""
    runs = F.transform(F.regexp_extract_all(t, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def text_width(t: Column, size: float) -> Column:
    """Estimated width: one em for wide characters and 0.55 for others."""
    wide = F.length(t) - F.length(F.regexp_replace(t, "[가-힣ㄱ-ㆎ一-鿿！-｠]", ""))
    return (wide + (F.length(t) - wide) * F.lit(0.55)) * F.lit(float(size))
