"""Identifiers that cleaning must not alter. Free of Spark, so that workers can import it."""

from __future__ import annotations

import re

#: Codes that begin document numbers; an organisation adds its own.
DOCUMENT_PREFIXES = ("DOC",)
# Identifiers that cleaning must not alter, in the order in which they are named.
PROTECTED = [
    ("EQUIPMENT_WITH_PREFIX", r"(?i)\b(?:Pump|Motor|Compressor|Turbine|Exchanger|Vessel|Tank|Furnace|Boiler|Reactor)\s+[A-Z]{1,4}[-_][0-9]{2,4}[A-Z]?\b"),
    ("VALVE_INSTRUMENT_TAG", r"(?i)\b(?:MOV|PSV|PRV|XV|FCV|TCV|PCV|LCV|ESD|SOV|PT|TT|LT|FT|PIT|TIT|LIT|FIT|TIC|PIC|LIC|FIC)[-_][0-9]{2,4}[A-Z]?\b"),
    ("EQUIPMENT_TAG", r"\b[A-Z]{1,3}[-_][0-9]{2,4}[A-Z]?\b"),
    ("STANDARDS", r"(?i)\b(?:API[- ]?[0-9]{2,4}[A-Z]?|OISD[- ]?[0-9]{2,4}|ASME(?:\s+[A-Z0-9.-]+)?|PNGRB(?:\s+[A-Z0-9.-]+)?|ISO[- ]?[0-9]{3,5}(?:-[0-9]+)?|ASTM\s+[A-Z0-9.-]+|NFPA[- ]?[0-9]{2,4})\b"),
    ("OPERATING_LIMITS", r"(?i)\b-?\d+(?:\.\d+)?\s*(?:bar|psi|kg/cm²|kg/cm2|kPa|MPa|mbar|°C|deg\s*C|°F|deg\s*F|m³/hr|m3/hr|m³/h|m3/h|Nm³/hr|Nm3/hr|L/min|lpm|GPM|kg/hr|kg/h)\b"),
    ("STANDALONE_UNITS", r"\b(?:kg/cm²|kg/cm2|m³/hr|m3/hr|Nm³/hr|Nm3/hr|MPa|kPa|psi|bar|°C)\b"),
    ("LOOP_OR_LINE", r"(?i)\b(?:Loop|Line|Pipe|P&ID|Drawing)\s*#?\s*[A-Z0-9\"'/_.-]+\b"),
    ("DOC_REVISION", rf"(?i)\b(?:(?:{'|'.join(DOCUMENT_PREFIXES)})[-_][A-Z0-9-]+|Rev(?:\.|ision)?\s*[A-Z0-9.-]+)\b"),
]
_PATTERNS = [re.compile(p) for _, p in PROTECTED]


def protected_spans(text: str) -> list[tuple[int, int]]:
    """Matches of all patterns without overlap: the earliest start first, then the longest."""
    found = sorted({m.span() for p in _PATTERNS for m in p.finditer(text)}, key=lambda s: (s[0], s[0] - s[1]))
    kept: list[tuple[int, int]] = []
    for a, z in found:
        if not kept or a >= kept[-1][1]:
            kept.append((a, z))
    return kept
