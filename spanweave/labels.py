"""Label sets and the tags that encode them."""

from __future__ import annotations

#: The entity labels in their order, and the pseudo-labels.
ENTITIES = ("PERSON", "BUSINESS", "ADDRESS", "DOB", "ACCOUNT", "PHONE", "EMAIL", "TIN")
IGNORE, OUTSIDE, DATE_CUE = "IGNORE", "O", "DATE_CUE"
#: Labels whose values end in a digit, so that a full stop after it is not theirs.
NUMERIC = ("ACCOUNT", "PHONE", "TIN", "DOB", "ADDRESS")
#: Source labels that name a place but no address.
PLACE_ONLY = ("city", "state", "county", "country", "CITY")


def bio_labels(entities: tuple[str, ...] = ENTITIES) -> list[str]:
    """``O``, then begin and inside tags of each entity."""
    return [OUTSIDE, *(f"{tag}-{e}" for e in entities for tag in "BI")]
