"""Column functions shared by operators: each stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(bound: Column, body) -> Column:
    """body(bound) with `bound` computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(bound), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero, and so is near nothing."""
    # The norm is repeated as an array: inside a lambda it would be computed for each component.
    return F.zip_with(v, F.array_repeat(F.nullif(norm(v), F.lit(0.0)), F.size(v)), lambda x, n: F.coalesce(x.cast("double") / n, F.lit(0.0)))


def visible_size(text: Column) -> Column:
    """Characters that are not white space (CHK-05)."""
    return F.length(F.regexp_replace(text, r"\s", ""))


def keep_tail(text: Column, limit: int, head_share: float = 0.25, marker: str = "\n[...]\n") -> Column:
    """Cut the middle of a long text: `head_share` of the room from its start, the rest from its end (CHK-15)."""
    room = max(limit - len(marker), 0)
    head = int(room * head_share)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(room - head))))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by NUL (PRJ-02)."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\0")))), 256)


def embedding_text(header: list[Column], context: Column, text: Column) -> Column:
    """Header parts joined by bars, then context, then text; empty parts are dropped (PRJ-01)."""
    some = lambda cols: F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(some([F.array_join(some(header), " | "), context, text]), "\n")


def first_folder(path: Column) -> Column:
    """First path component, or `root` (PRJ-16)."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("root"))


def title_of(text: Column, limit: int = 60) -> Column:
    """White space collapsed, cut with an ellipsis (PRJ-14)."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores (PRJ-15)."""
    return F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w.\-]+", "_"), r"^[._]+|[._]+$", "")


def strip_magics(source: Column) -> Column:
    """Blank the notebook lines that start with % or ! (AST-06)."""
    return F.regexp_replace(source, r"(?m)^[ \t]*[%!].*$", "")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def source_priority(url: Column, prefer: list[str], demote: list[str]) -> Column:
    """-1 for a demoted substring, which is checked first, 1 for a preferred host or its subdomains, else 0 (PRJ-09)."""
    host = url_host(url)
    good = [(host == p) | host.endswith("." + p) for p in prefer]
    bad = [F.lower(url).contains(d) for d in demote]
    any_of = lambda tests: F.coalesce(F.greatest(*tests) if len(tests) > 1 else tests[0], F.lit(False)) if tests else F.lit(False)
    return F.when(any_of(bad), -1).when(any_of(good), 1).otherwise(0)


#: Addresses in a text, and the words of a query (fixed values).
URL = r"https?://[^\s<>()\"'`\]]+"
POLICY_WORD = r"[\w][\w.\-]*[\w]|\w"


def urls_in(text: Column) -> Column:
    """Distinct URLs without the punctuation that ends a sentence (PRJ-10)."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no slash at the path's end, no fragment (PRJ-10)."""
    part = lambda i: F.regexp_extract(F.trim(url), r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]+)?", i)
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""), part(4))


def policy_words(text: Column) -> Column:
    """Words with inner dots and hyphens, lower-cased, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?U)" + POLICY_WORD), F.lit(0)), F.lower))


def words(text: Column) -> Column:
    """Unicode word runs, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"


def identifiers(text: Column) -> Column:
    """Distinct identifiers in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))


def code_like(name: Column) -> Column:
    """An underscore, a digit, or a capital after the first letter (FLT-05)."""
    return name.rlike(r"_|\p{Nd}|^.+\p{Lu}")


def distinctive_tokens(text: Column) -> Column:
    """Tokens that tell private content apart, lower-cased, each once (PRJ-11).

    Of five characters or more with a letter: those with a digit, an underscore, an inner capital, a
    hyphen before a capital or digit, and words in capitals from six on. Without a letter: those of
    four digits or more that are no year from 1900 to 2100.
    """
    tokens = F.regexp_extract_all(text, F.lit("(?U)" + POLICY_WORD), F.lit(0))

    def kept(t: Column) -> Column:
        letters, capitals = t.rlike(r"\p{L}"), (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) >= 6)
        named = t.rlike(r"\p{Nd}|_|[a-z][A-Z]|[A-Za-z]-[A-Z0-9]") | capitals
        year = t.rlike(r"^(19\d\d|20\d\d|2100)$")
        return (letters & (F.length(t) >= 5) & named) | (~letters & (F.length(F.regexp_replace(t, r"(?U)\D", "")) >= 4) & ~year)

    return F.array_distinct(F.transform(F.filter(tokens, kept), F.lower))


NUMBER = r"[-+]?(?:\d+[.,]\d+|\d+|[.,]\d+)(?:[eE][-+]?\d+)?"


def numbers(text: Column) -> Column:
    """Numbers of a text as doubles; a decimal comma counts as a point (PRJ-07)."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(".")).try_cast("double")), lambda n: n.isNotNull())


def missing_numbers(body: Column, pool: Column) -> Column:
    """Numbers of two digits or more in `body` that `pool` has neither as written, nor with a decimal point, nor without commas (GRD-05)."""
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    long_ = F.filter(found, lambda n: F.length(F.regexp_replace(n, r"\D", "")) >= 2)
    held = lambda n: F.contains(pool, n) | F.contains(pool, F.replace(n, F.lit(","), F.lit("."))) | F.contains(pool, F.replace(n, F.lit(","), F.lit("")))
    return F.filter(long_, lambda n: ~held(n))


def main_text(html: Column) -> Column:
    """Visible blocks of a page: scripts, styles, navigation, headers and footers dropped, repeated blocks kept once (PRJ-13)."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|noscript|svg|form)\b[^>]*>.*?</(script|style|nav|header|footer|aside|noscript|svg|form)>", " ")
    bare = F.regexp_replace(bare, r"(?is)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?i)</?(p|div|li|ul|ol|h[1-6]|tr|table|br|pre|blockquote|section|article|td|th|title)\b[^>]*>", "\u0001")
    bare = F.regexp_replace(bare, r"<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    blocks = F.transform(F.split(bare, "\u0001"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))
    return F.array_join(F.array_distinct(F.filter(blocks, lambda b: F.length(b) >= 3)), "\n")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def relevance_verdict(best: Column, low: float = 0.02, high: float = 0.5) -> Column:
    """Three-way verdict on the best relevance score (FLT-19)."""
    return F.when(best >= high, "correct").when(F.coalesce(best, F.lit(0.0)) < low, "incorrect").otherwise("ambiguous")


def location_label(path: Column, page: Column, section: Column, cell: Column, line_start: Column, line_end: Column) -> Column:
    """`path, page p, section, cell c, lines a-b` of the parts that are there (PRJ-03)."""
    lines = F.when(line_start.isNotNull(), F.format_string("lines %d-%d", line_start, F.coalesce(line_end, line_start)))
    return F.concat_ws(", ", path, F.when(page.isNotNull(), F.format_string("page %d", page)), F.nullif(section, F.lit("")), F.when(cell.isNotNull(), F.format_string("cell %d", cell)), lines)


#: Markdown that asks for something when it is shown, code, and what stands for a picture (fixed values).
MARKDOWN_IMAGE = r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)"
MARKDOWN_LINK = r"(?<!!)\[([^\]]+)\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)"
BARE_URL = r"(?<![`\w])(https?://[^\s<>()`]+)"
MARKDOWN_CODE = r"(?s)```.*?```|`[^`\n]*`"
PICTURE, NO_CAPTION = "[изображение: %s] `%s`", "без подписи"


def defang_markdown(text: Column) -> Column:
    """Images, links and addresses made inert, so that showing the text asks for nothing (PRJ-12).

    Images and links give their text and their address as code; bare addresses become code where
    they are not in code already.
    """
    text = F.regexp_replace(text, MARKDOWN_IMAGE.replace("([^\\]]*)", "()", 1), PICTURE % (NO_CAPTION, "$2"))
    text = F.regexp_replace(text, MARKDOWN_IMAGE, PICTURE % ("$1", "$2"))
    text = F.regexp_replace(text, MARKDOWN_LINK, "$1 (`$2`)")
    text = F.regexp_replace(text, r"(?m)^\s*(\[[^\]]+\]:\s*\S+.*?)[^\S\n]*$", "`$1`")
    spans = F.regexp_extract_all(text, F.lit(MARKDOWN_CODE), F.lit(0))
    between = F.split(text, MARKDOWN_CODE, -1)
    inert = lambda p: F.regexp_replace(p, BARE_URL, "`$1`")
    return F.array_join(F.flatten(F.zip_with(between, spans, lambda b, c: F.array(inert(b), F.coalesce(c, F.lit(""))))), "")


def held_out(path: Column, share: float) -> Column:
    """Deterministic split (PRJ-18): SHA-1 of the path, modulo 1000, below share * 1000.

    The 160-bit digest is reduced ten hexadecimal digits at a time.
    """
    digest = F.sha1(path)
    rest = F.lit(0).cast("long")
    for i in range(0, 40, 10):
        part = F.conv(F.substring(digest, i + 1, 10), 16, 10).cast("long")
        rest = (rest * (16**10 % 1000) + part % 1000) % 1000
    return rest < int(share * 1000)


#: Requests that need the web, code, an overview, a picture, a change of one, or a video (fixed values).
INTENTS = {
    "web": (
        r"(в|по)\s+интернет|в\s+сети\b|онлайн|погугли|загугли|поищи\s+(в\s+)?(интернет|сети|онлайн)|"
        r"найди\s+в\s+(интернете|сети)|выйти\s+в\s+(интернет|сеть)|search\s+(the\s+)?(web|internet)|"
        r"google\s+it|look\s+it\s+up\s+online"
    ),
    "code": (
        r"запус|выполни|прогон|построй|нарисуй|сохрани|создай|исправь|почини|посчитай|пересчитай|вычисли|собери|"
        r"сгенерируй|экспортир|конвертир|преобразуй|скачай|выгрузи|установи|протестируй|попробуй|спарс|распарс|парсер|"
        r"(напиши|сделай|разработай|реализуй|спроектируй)\s+(\S+\s+){0,3}?(программ|сервис|приложени|бот|утилит|проект|api)|"
        r"\b(run|execute|plot|fix|save|compute|create|generate|convert|download|install|scrape|parse)\b"
    ),
    "overview": (
        r"о\s+ч[её]м|расска[зж]|опиши|описа|суть|кратк|резюм|конспект|перескаж|основн\w+\s+(иде|мысл|вывод)|"
        r"концепци|иде[яюи]\b|что\s+(в\s+(нём|нем|файле|документе)|можешь\s+сказать)|"
        r"summar|overview|what\s+is\s+(it|this|the\s+file)\s+about|main\s+idea"
    ),
    "image": (
        r"нарису|сгенерир\w*\s+(картин|изображ|фото|рисун|арт|логотип|иконк|обо)|изобрази|перерису|дорису|"
        r"отредактир\w*\s+(картин|фото|изображ)|измени\w*\s+(на\s+)?(картин|фото|изображ)|(сделай|создай)\s+(картин|изображ|фото|рисун|арт|логотип|иконк|обо)|"
        r"картинк|рисун|иллюстрац|\b(draw|paint|illustrate|render|sketch|outpaint|inpaint)\b|"
        r"generate\s+(an?\s+)?(image|picture|photo|illustration|logo)|расшир\w*\s+(картин|фото|изображ|холст)"
    ),
    "edit": (
        r"в\s+стил|стилиз|\bфон(а|у|ом|е|ы|ов)?\b|измени|поменя|замени|убери|добавь|перекрас|раскрас|акварел|аниме|"
        r"маслом|карандаш|ярче|темнее|светлее|ч[её]рно-бел|преврати|сделай\s+из|в\s+образе|сохрани\w*\s+(поз|лиц|освещ|"
        r"композиц|черт)|image.?to.?image|img2img|\bi2i\b|\b(make it|in the style|background|recolou?r|turn (it|me) into)\b"
    ),
    "video": r"видео|ролик|клип\b|анимир|анимаци|оживи|оживить|\b(video|animate|animation|clip)\b",
}


def _alternatives(pattern: str) -> list[str]:
    """A pattern cut at the bars outside of its groups."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _first_letters(alternative: str) -> set[str]:
    """The letters that a match of one of INTENTS' alternatives may begin with."""
    rest = alternative.removeprefix(r"\b")
    if rest.startswith("("):
        return {x for a in _alternatives(rest[1:].split(")")[0]) for x in _first_letters(a)}
    if not rest[:1].isalpha() or rest[1:2] in ("?", "*", "{"):
        raise ValueError(f"an alternative begins with a letter: {alternative}")
    return {rest[0]}


#: Letters that a Russian alternative needs, those that fold to them included.
CYRILLIC = r"[\u0400-\u052F\u1C80-\u1C8F]"


def wants(question: Column, kind: str) -> Column:
    """Intent gates on a question (FLT-18): one of INTENTS; a null question wants nothing.

    Russian alternatives, which all have such a letter, are only tried on texts with one; the
    others only where the first letter of one stands.
    """

    def holds(alternatives: list[str]) -> Column:
        first = "".join(sorted({x for a in alternatives for x in _first_letters(a)}))
        return question.rlike(f"(?iU)(?=[{first}])(?:{'|'.join(alternatives)})") if alternatives else F.lit(False)

    russian, others = [], []
    for a in _alternatives(INTENTS[kind]):
        (russian if all("\u0400" <= x <= "\u052f" for x in _first_letters(a)) else others).append(a)
    return F.coalesce((question.rlike(CYRILLIC) & holds(russian)) | holds(others), F.lit(False))


#: Namespace of point ids; sides and area of generated pictures (fixed values).
POINT_SPACE = "6f1c1f5e2b0e4c559d538f2a3c1b7e10"
MAX_SIDE, MAX_AREA = 3072, 2752 * 1536


def point_id(node_id: Column) -> Column:
    """The name-based UUID (version 5) of a node's id (PRJ-05)."""

    def of(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

    return F.when(node_id.isNotNull(), let(F.sha1(F.concat(F.unhex(F.lit(POINT_SPACE)), F.encode(node_id, "UTF-8"))), of))


def grid_size(width: Column, height: Column, cut: bool = False) -> Column:
    """Sides on a grid of 32, of 256 at least, shrunk in proportion to the largest side and area; null unless both are positive (PRJ-19)."""
    area = F.sqrt(F.lit(float(MAX_AREA)) / (width.cast("double") * height))
    scale = F.least(F.lit(1.0), F.lit(float(MAX_SIDE)) / F.greatest(width, height), area)
    side = lambda v: F.greatest(F.lit(256), ((F.floor if cut else F.rint)(v * scale / 32) * 32).cast("int"))
    return F.when((width > 0) & (height > 0), F.struct(side(width).alias("width"), side(height).alias("height")))


def source_size(width: Column, height: Column, most: int = 1344, least: int = 1024) -> Column:
    """Sides in the source's proportions, the longer one between `least` and `most`, cut to the grid of 32 (PRJ-19)."""
    longer = F.greatest(width, height)
    scale = F.when(longer < least, F.lit(float(least)) / longer).otherwise(F.least(F.lit(1.0), F.lit(float(most)) / longer))
    side = lambda v: F.greatest(F.lit(256), (F.floor(F.floor(v * scale) / 32) * 32).cast("int"))
    return F.when((width > 0) & (height > 0), F.struct(side(width).alias("width"), side(height).alias("height")))


def clip_frames(seconds: Column, fps: int, default: int) -> Column:
    """Frames of a clip, one more than a multiple of 8, between 9 and 241 (PRJ-19)."""
    frames = (F.rint((seconds * fps - 1) / 8) * 8 + 1).cast("int")
    return F.when(seconds > 0, F.greatest(F.lit(9), F.least(F.lit(241), frames))).otherwise(default)


def step_cost(width: Column, height: Column, edit: Column) -> Column:
    """Cost of a generation step: grows faster than the pixels, an edit counts them twice (PRJ-19)."""
    pixels = width.cast("double") * height / 1e6 * F.when(edit, 2).otherwise(1)
    return pixels * (1 + pixels / 4.4)
