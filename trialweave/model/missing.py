"""Missing-value markers and their stable codes."""

from __future__ import annotations

#: Code -> display text of each marker.
MISSING_TEXT = {
    10: "NA", 20: "None", 21: "np.nan", 22: "pd.NA", 23: "pd.NaT", 60: "._", 64: ".",
    **{code: f".{chr(code)}" for code in range(65, 91)},
    101: "<UKN>", 102: "<ERR>",
}
MISSING_CODES = {text: code for code, text in MISSING_TEXT.items()}

MIS, MIS_UNKNOWN, MIS_ERROR = 64, 101, 102
