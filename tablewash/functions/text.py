"""Text rules that must read like SQL's, not Java's.

``upper`` in Spark uses Java's full case mapping, where some characters
become two (``ß`` -> ``SS``, ``ﬁ`` -> ``FI``). SQL ``ucase`` keeps one
character per character. The two agree everywhere except on the characters
listed below (every character whose full upper case is longer than one
character); :func:`sql_upper` maps those the SQL way and leaves the rest to
Spark's built-in ``upper``. Everything stays in JVM built-ins: a text whose
length ``upper`` keeps holds no listed character and is done; otherwise the
listed characters are swapped for private-use placeholders, the text is
upper-cased, and the placeholders are swapped for their targets. A text that already holds
a placeholder character takes an exact character-by-character path instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters whose full upper case has several characters, in
# code point order, and what SQL ``ucase`` gives for each (same order).
MULTI_UPPER = (
    'ßŉǰΐΰևẖẗẘẙẚὐὒὔὖᾀᾁᾂᾃᾄᾅᾆᾇᾈᾉᾊᾋᾌᾍᾎᾏᾐᾑᾒ'
    'ᾓᾔᾕᾖᾗᾘᾙᾚᾛᾜᾝᾞᾟᾠᾡᾢᾣᾤᾥᾦᾧᾨᾩᾪᾫᾬᾭᾮᾯᾲᾳᾴᾶᾷ'
    'ᾼῂῃῄῆῇῌῒΐῖῗῢΰῤῦῧῲῳῴῶῷῼﬀﬁﬂﬃﬄﬅﬆﬓﬔﬕﬖﬗ'
)
SQL_UPPER_OF = (
    'ẞŉǰΐΰևẖẗẘẙẚὐὒὔὖᾈᾉᾊᾋᾌᾍᾎᾏᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚ'
    'ᾛᾜᾝᾞᾟᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾨᾩᾪᾫᾬᾭᾮᾯᾲᾼᾴᾶᾷ'
    'ᾼῂῌῄῆῇῌῒΐῖῗῢΰῤῦῧῲῼῴῶῷῼﬀﬁﬂﬃﬄﬅﬆﬓﬔﬕﬖﬗ'
)

# Private-use placeholders (plane 15), one per listed character.
_PLACEHOLDERS = "".join(chr(0xF0000 + i) for i in range(len(MULTI_UPPER)))
_PLACEHOLDER_CLASS = "[\\x{F0000}-\\x{%X}]" % (0xF0000 + len(MULTI_UPPER) - 1)


def sql_upper(c: Column) -> Column:
    """Upper case the way SQL ``ucase`` does (one character per character)."""
    fast = F.translate(F.upper(F.translate(c, MULTI_UPPER, _PLACEHOLDERS)),
                       _PLACEHOLDERS, SQL_UPPER_OF)
    table = F.create_map(*[F.lit(x) for pair in zip(MULTI_UPPER, SQL_UPPER_OF) for x in pair])
    exact = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(table, ch), F.upper(ch))),
        "")
    # Upper-casing never shortens a character, and the listed characters are
    # exactly the ones Java lengthens: an unchanged length means the built-in
    # result is already the SQL one (a cheap test, no regex, no translate).
    plain = F.upper(c)
    return (F.when(F.length(plain) == F.length(c), plain)
            .when(~c.rlike(_PLACEHOLDER_CLASS), fast)
            .otherwise(exact))
