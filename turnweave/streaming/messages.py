"""Live messages: one leading byte names the kind, the rest is its payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by first byte.
KINDS = ("handshake", "audio", "text", "control", "metadata", "error", "ping", "coloured")
TEXTUAL = ("text", "metadata", "error")


def decode_message(message: Column) -> Column:
    """Struct (kind, payload, text) of a binary message; text only for kinds that carry it.

    An empty message is "empty", an unknown first byte "unknown", null gives nulls. A coloured text has
    one byte of colour before its text.
    """
    head = F.conv(F.hex(F.substring(message, 1, 1)), 16, 10).cast("int")
    kind = F.when(message.isNull(), F.lit(None)).when(F.length(message) == 0, "empty")
    for k, name in enumerate(KINDS):
        kind = kind.when(head == k, name)
    kind = kind.otherwise("unknown")
    rest = F.substring(message, F.lit(2), F.length(message))
    text = F.when(kind.isin(*TEXTUAL), F.decode(rest, "UTF-8")).when(kind == "coloured", F.decode(F.substring(message, F.lit(3), F.length(message)), "UTF-8"))
    return F.struct(kind.alias("kind"), rest.alias("payload"), text.alias("text"))
