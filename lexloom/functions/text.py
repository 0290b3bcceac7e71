"""Text cleaning as column expressions: string column in, string or boolean column out, no Python at run time.

Null in, null out. ``(?U)`` makes Java's ``\\s \\w \\b \\d`` Unicode-aware.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, character maps and markers of the cleaning steps.
NOISE = (r"(?U)第\s*[0-9]+\s*页", r"(?U)共\s*[0-9]+\s*页", r"(?U)\b页码:\s*[0-9]+", r"(?U)\b页眉:.*", r"(?U)\b页脚:.*", r"-{3,}", r"={3,}")
FULL_WIDTH = ("　＃＄％＆（）［］｛｝＂＇“”‘’", " #$%&()[]{}\"'\"\"''")
PUNCTUATION = ("。，；：！？（）【】《》", ".,;:!?()[]<>")
NOISE_LINES = (r"(?m)^.*[0-9]{1,2}/[0-9]{1,2}.*$", r"(?m)©.*$", r"(?m)版权.*$", r"(?U)https?://\S+", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
NOT_KEPT = r"[^\x20-\x7E\u4e00-\u9FFF]"
MARKDOWN_MARKERS = ("# ", "## ", "```", "> ", "- ", "* ")
CODE_MARKERS = ("def ", "class ", "import ", "from ", "function ", "var ", "let ", "const ", "public ", "private ", "#include ", "int main")
LEGAL_MARKERS = ("第", "条", "款", "项", "中华人民共和国", "最高人民法院", "最高人民检察院", "法律", "法规", "条例", "办法", "规定", "第一条", "第二条", "第三条")
HEADING_STARTS = ("第", "章", "节", "条", "款", "项", "一、", "二、", "三、", "四、", "五、", "1.", "2.", "3.", "4.", "5.", "I.", "II.", "III.", "IV.", "V.", "A.", "B.", "C.", "D.", "E.")


def strip(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense and with the separators U+001C to U+001F."""
    return F.regexp_replace(c, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def preprocess(c: Column) -> Column:
    """Line ends to LF, each line stripped and its white space squeezed, at most one blank line, three marks to ASCII."""
    t = F.regexp_replace(strip(c), "\r\n?", "\n")
    t = F.regexp_replace(t, "(?U)[\\s\\x1c-\\x1f&&[^\n]]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return strip(F.translate(t, "。，；", ".,;"))


def normalise_punctuation(c: Column) -> Column:
    t = F.translate(c, *PUNCTUATION)
    t = F.regexp_replace(t, r"(?U)([,.!?;:])\s*", "$1 ")
    return F.regexp_replace(t, r"(?U)\s+([,.!?;:])", "$1")


def drop_special(c: Column, not_kept: str = NOT_KEPT) -> Column:
    return F.regexp_replace(F.regexp_replace(c, CONTROL, ""), not_kept, "")


def clean(c: Column, not_kept: str = NOT_KEPT) -> Column:
    """White space first, so a header mark eats the rest of the text; then noise, punctuation, special characters."""
    t = F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")
    # every pattern needs one of these, so most texts are spared the search
    noisy = F.contains(c, F.lit("页")) | F.contains(c, F.lit("---")) | F.contains(c, F.lit("==="))
    t = F.when(noisy, reduce(lambda x, p: F.regexp_replace(x, p, ""), NOISE, t)).otherwise(t)
    return strip(drop_special(normalise_punctuation(t), not_kept))


def half_width(c: Column) -> Column:
    return F.translate(c, *FULL_WIDTH)


def remove_noise(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), NOISE_LINES, c)


def clean_legal(c: Column, not_kept: str = NOT_KEPT) -> Column:
    t = F.regexp_replace(clean(c, not_kept), r"(?U)第\s*([零一二三四五六七八九十百千万0-9]+)\s*条", "第$1条")
    return t


def clean_for_analysis(c: Column, dropped: str = r"(?U)[^\u4e00-\u9fa5a-zA-Z0-9\s]") -> Column:
    """Without HTML tags and all but letters, digits and white space, squeezed."""
    t = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), dropped, "")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def _has(c: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in marks])


def is_markdown(c: Column) -> Column:
    return _has(F.substring(c, 1, 1000), MARKDOWN_MARKERS)


def flatten_markdown(c: Column) -> Column:
    """Headings, quotes and list items marked by words; fences go, what they enclose stays as it is."""
    # split at fence lines, of which every other one opens: parts 1, 3, ... are code
    fences = F.split(F.concat(F.lit("\n"), F.array_join(F.transform(F.split(c, "\n"), strip), "\n"), F.lit("\n")), "(?<=\n)```[^\n]*\n")

    def plain(line):
        return (
            F.when(line.startswith("#"), F.concat(F.lit("标题: "), strip(F.regexp_replace(line, "^#+", ""))))
            .when(line.startswith("> "), F.concat(F.lit("引用: "), strip(F.regexp_replace(line, "^>+", ""))))
            .when(line.startswith("- ") | line.startswith("* "), F.concat(F.lit("• "), strip(F.regexp_replace(line, "^[-*]+", ""))))
            .otherwise(line)
        )

    lines = F.transform(fences, lambda part, i: F.when(i % 2 == 1, part).otherwise(F.array_join(F.transform(F.split(part, "\n"), plain), "\n")))
    # the line ends put around the text go again
    return F.regexp_replace(F.array_join(lines, ""), "\\A\n|\n\\z", "")


def mark_code(c: Column) -> Column:
    return F.when(_has(F.substring(c, 1, 2000), CODE_MARKERS), F.concat(F.lit("代码文件内容:\n"), c)).otherwise(c)


def is_legal(c: Column, markers=LEGAL_MARKERS) -> Column:
    return _has(F.substring(c, 1, 500), markers)


def is_heading(c: Column) -> Column:
    begins = reduce(lambda a, b: a | b, [c.startswith(s) for s in HEADING_STARTS])
    upper = (F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) > 3)
    return (F.length(c) < 50) & (begins | upper)


def table_text(rows: Column, drop_blank: bool = True) -> Column:
    """Rows of cells to lines with `` | `` between cells; a null cell is empty."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda x: F.coalesce(x, F.lit(""))))
    if drop_blank:
        cells = F.filter(cells, lambda r: F.exists(r, lambda x: strip(x) != ""))
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, " | ")), "\n")


def safe_filename(c: Column, longest: int = 255) -> Column:
    """Characters that file systems refuse become ``_``; the extension outlives a cut."""
    t = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")
    ext = F.regexp_extract(t, r"(\.[^.]*)$", 1)
    return F.when(F.length(t) > longest, F.concat(F.substring(t, F.lit(1), F.lit(longest) - F.length(ext)), ext)).otherwise(t)


def file_size_label(c: Column) -> Column:
    label, unit = F.lit(None), 1
    for i, name in enumerate(("B", "KB", "MB", "GB", "TB")):
        # halves go to the even digit, as C and Python print them; Java's format would round them up
        value = F.format_string("%.2f " + name, F.bround(c / F.lit(float(1024**i)), 2))
        top = 1024 ** (i + 1)
        label = F.when((c >= unit if i else F.lit(True)) & ((c < top) if i < 4 else F.lit(True)), value).otherwise(label)
        unit = top
    return F.when(c == 0, F.lit("0 B")).otherwise(label)


def split_path(c: Column) -> Column:
    """Struct (directory, stem, extension) of a path."""
    name = F.regexp_extract(c, r"([^/]*)$", 1)
    stem = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.struct(F.regexp_extract(c, r"^(.*)/", 1).alias("directory"), stem.alias("stem"), ext.alias("extension"))


def valid_path(c: Column, longest: int = 260) -> Column:
    return (F.length(c) <= longest) & ~c.rlike(r'[<>"|?*]')


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def vector_head(vector: Column, n: int = 10) -> Column:
    """The first ``n`` components, for previews."""
    return F.slice(vector, 1, n)


def duration_label(minutes: Column) -> Column:
    m = F.floor(minutes)
    hours, days = F.floor(m / 60), F.floor(m / 1440)
    return (
        F.when(m < 60, F.concat(m.cast("string"), F.lit("分钟")))
        .when(m < 1440, F.concat(hours.cast("string"), F.lit("小时")))
        .otherwise(F.concat(days.cast("string"), F.lit("天")))
    )


def relative_time_label(then: Column, as_of: Column) -> Column:
    seconds = F.unix_seconds(as_of) - F.unix_seconds(then)
    return (
        F.when(seconds < 60, F.lit("刚刚"))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("分钟前")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("小时前")))
        .when(seconds < 604800, F.concat(F.floor(seconds / 86400).cast("string"), F.lit("天前")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )
