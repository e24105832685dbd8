"""Markdown and links of a page as column expressions: tags become one-character marks, and rewriting does the rest.

A page is cleaned, and its tags are cut out: what stands between them is decoded and joined again around marks for breaks,
kept spaces and links. The layout then follows from the marks alone: white space shrinks, the widest break of a run
stands, and what lies between the two marks of a link is its label. Only URLs go through a parser, all of a page at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import urls
from tracewell.functions.formats import END, S, attribute, without_data_markup

#: Entities that are decoded by name (a no-break space becomes a space).
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
#: Elements that stand as blocks of their own in markdown.
BLOCKS = ["p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "blockquote", "pre", "table", "tr", "ul", "ol"]
ENTITY = r"(?i)&(?:#(?:x[0-9a-f]+|[0-9]+)|[a-z][a-z0-9]+);"
TAG = "<[^>]*>"
#: The marks, from the private use area; a page's own characters of these codes are taken out.
BLOCK, LINE, KEEP, OPEN, TARGET, RAW, CLOSE, HERE = (chr(0xE000 + k) for k in range(8))
MARKS = f"[{BLOCK}-{HERE}]"


def interleaved(pieces: Column, between: Column) -> Column:
    """Pieces of a text with something put back between them."""
    return F.array_join(F.zip_with(pieces, between, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


def character(digits: Column, base: int) -> Column:
    """The character of a code in digits; the replacement character if there is none."""
    short = F.regexp_replace(digits, "^0+", "")
    code = F.conv(F.when(F.length(short) > 8, "7fffffff").otherwise(F.concat(F.lit("0"), short)), base, 10).cast("long")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


def decoded(text: Column) -> Column:
    """Entities by number, and the few by name, as characters; others stay."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(e: Column) -> Column:
        name = F.lower(F.regexp_replace(e, "[&;]", ""))
        by_number = F.when(name.startswith("#x"), character(F.substring(name, 3, 1 << 20), 16)).when(name.startswith("#"), character(F.substring(name, 2, 1 << 20), 10))
        return F.coalesce(by_number, named[name], e)

    whole = interleaved(F.split(text, ENTITY, -1), F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), one))
    return F.when(text.contains("&"), whole).otherwise(text)


def shrunk(text: Column) -> Column:
    return F.regexp_replace(text, f"{S}+", " ")


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, rf"^<{S}*/?{S}*([A-Za-z][A-Za-z0-9_:-]*)", 1))


def is_closing(tag: Column) -> Column:
    return tag.rlike(rf"^<{S}*/")


def mark(tag: Column) -> Column:
    """What a tag leaves in the text, but for the targets of links."""
    name, closing = tag_name(tag), is_closing(tag)
    heading = F.concat(F.lit(BLOCK), F.repeat(F.lit("#"), F.substring(name, 2, 1).cast("int")), F.lit(KEEP))
    alt = F.trim(shrunk(decoded(F.coalesce(attribute(tag, "alt"), F.lit("")))))
    return (
        F.when((name == "a") & closing, CLOSE)
        .when(name == "a", OPEN)
        .when(name.rlike("^h[1-6]$"), F.when(closing, BLOCK).otherwise(heading))
        .when(name == "br", LINE)
        .when(name == "li", F.when(closing, LINE).otherwise(f"{LINE}-{KEEP}"))
        .when(name.isin(BLOCKS), BLOCK)
        .when((name == "img") & ~closing, alt)
        .otherwise("")
    )


def laid_out(text: Column) -> Column:
    """The breaks of marked text as line feeds: of a run the widest, with no space on either side."""
    wide = rf"[ {KEEP}]*(?:[{BLOCK}{LINE}] *)*{BLOCK}(?: *[{BLOCK}{LINE}])* *"
    text = F.regexp_replace(text, f"{KEEP} +", KEEP)
    text = F.regexp_replace(F.regexp_replace(text, wide, "\n\n"), rf"[ {KEEP}]*{LINE}(?: *{LINE})* *", "\n")
    return F.replace(text, F.lit(KEEP), F.lit(" "))


def linked(text: Column) -> Column:
    """Marked links with their labels; a mark without its other half goes."""
    inside = rf"(?=[^{OPEN}{CLOSE}]*{CLOSE})"
    label = rf"[^{OPEN}-{CLOSE}]"
    text = F.regexp_replace(text, rf"([\[\]\\]){inside}(?=[^{TARGET}{RAW}]*{CLOSE})", r"\\$1")
    text = F.regexp_replace(text, rf"{OPEN}([^{TARGET}]*){TARGET}([^{RAW}]*){RAW}{S}*{CLOSE}", "[$2]($1)")
    text = F.regexp_replace(text, rf"{OPEN}([^{TARGET}]*){TARGET}[^{RAW}]*{RAW}{S}*({label}*?){S}*{CLOSE}", "[$2]($1)")
    alone = f"(?:{OPEN}[^{RAW}]*{RAW}|{CLOSE})+"
    return F.regexp_replace(F.regexp_replace(text, f" {alone} ", " "), alone, "")


def markdown(source: Column, base: Column) -> Column:
    """Markdown of a page: headings, list items, links, breaks and image texts. Nested links lose the outer one."""
    body = F.regexp_replace(without_data_markup(F.regexp_replace(source, MARKS, "")), rf"(?is)<head{END}[^>]*>.*?</head{S}*>", "")
    tags = F.regexp_extract_all(body, F.lit(TAG), F.lit(0))
    anchors = F.filter(tags, lambda t: (tag_name(t) == "a") & ~is_closing(t))
    targets = urls.resolve_each(F.transform(anchors, lambda t: decoded(attribute(t, "href"))), base)
    safe = lambda u: F.replace(F.replace(F.replace(u, F.lit("\\"), F.lit("%5C")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    opened = F.transform(targets, lambda u: F.when(u.isNotNull(), F.concat(F.lit(OPEN), safe(u), F.lit(TARGET), u, F.lit(RAW))))
    # Decoded as one text, with a mark where tags were; a < that opens no tag goes.
    plain = shrunk(decoded(F.replace(F.regexp_replace(body, TAG, HERE), F.lit("<"), F.lit(""))))
    marked = interleaved(F.split(plain, HERE, -1), F.transform(tags, mark))
    # White space on both sides of a tag that leaves nothing is one space.
    marked = F.regexp_replace(interleaved(F.split(marked, OPEN, -1), opened), " +", " ")
    text = linked(laid_out(marked))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, rf"\A{S}+|{S}+\z", "")
    return F.when(text == "", "").otherwise(F.concat(text, F.lit("\n")))


def markup_candidates(source: Column) -> Column:
    """What markup offers as links: any tag's href, and the texts of <loc> and <link> elements."""
    text = without_data_markup(source)
    hrefs = F.transform(F.regexp_extract_all(text, F.lit("<[^>]+>"), F.lit(0)), lambda t: attribute(t, "href"))
    texts = F.regexp_extract_all(text, F.lit(rf"(?i)<(?:loc|link){END}[^>]*>([^<]*)</(?:loc|link){S}*>"), F.lit(1))
    return F.transform(F.array_compact(F.concat(hrefs, F.transform(texts, lambda t: F.trim(t)))), decoded)


def markup_links(source: Column, base: Column) -> Column:
    """Sorted admitted URLs of a page in HTML or XML."""
    return urls.resolve_all(markup_candidates(source), base)
