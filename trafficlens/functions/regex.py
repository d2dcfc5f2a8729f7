"""Turn ECMAScript patterns into Java patterns that match the same strings.

Java's ``\\b`` and ``\\s`` differ from ECMAScript's: the boundary there is ASCII-only, the white space is not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession

ASCII_WORD = "[A-Za-z0-9_]"
ASCII_B = f"(?:(?<={ASCII_WORD})(?!{ASCII_WORD})|(?<!{ASCII_WORD})(?={ASCII_WORD}))"
ASCII_NOT_B = f"(?:(?<={ASCII_WORD})(?={ASCII_WORD})|(?<!{ASCII_WORD})(?!{ASCII_WORD}))"
WS = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES = ("\t\n\v\f\r \u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
NOT_WS = r"[^\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

_TOKEN = re.compile(r"\\.|\[|\]|[^\\\[\]]+", re.S)


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    out, in_class = [], False
    for token in _TOKEN.findall(pattern):
        if token == "[":
            # A bare "[" inside an ECMAScript class is a literal; Java would open a nested class.
            out.append(r"\[" if in_class else "[")
            in_class = True
        elif token == "]":
            out.append("]")
            in_class = False
        elif token == r"\s":
            out.append(WS)
        elif token == r"\S":
            out.append(NOT_WS)
        elif token == r"\b" and not in_class:
            out.append(ASCII_B)
        elif token == r"\B" and not in_class:
            out.append(ASCII_NOT_B)
        else:
            out.append(token)
    return ("(?i)" if ignore_case else "") + "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(java_pattern(pattern, ignore_case))


def literal_replacement(value: str) -> str:
    """Escape a replacement text so that ``$`` and ``\\`` lose their meaning."""
    return value.replace("\\", "\\\\").replace("$", "\\$")


def usable(spark: SparkSession, pattern: str) -> bool:
    """True when Spark can compile the pattern; unusable user patterns are skipped, never an error. Runs no job."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
        return True
    except IllegalArgumentException:
        return False
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "PatternSyntaxException":
            raise
        return False
