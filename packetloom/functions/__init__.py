"""Column helpers shared by the operators."""

from packetloom.functions.text import (  # noqa: F401
    bounded_preview,
    each,
    escaped_preview,
    explode_matches,
    form_decode,
    octets,
    stable_id,
    with_matches,
)
