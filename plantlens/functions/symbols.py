"""What symbol names say: role on the drawing, function code and family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by role, tried in this order.
ROLE_NAMES = {
    "border": ("DBORDH", "DBORDV", "TITLE", "REV"),
    "frame": ("LINE", "BOX1", "BOX2"),
    "connector": ("N90CNECT",),
    "input-ref": ("IREF", "IREFO", "IREFI"),
    "output-ref": ("OREF", "OREFO", "OREFI"),
    "logic": (
        "AND", "AND2", "AND4", "AND8", "OR", "OR2", "OR4", "OR8", "NOT", "XOR", "SR", "QOR", "TD-DIG", "T-DIG", "T-AN", "ETIMER", "PID", "SUM", "ADD", "SUB", "MUL", "DIV",
        "H/L", "HLAG", "LEAD", "RAMP", "RCM", "SEQ", "SEQGEN", "SEQMON", "REMSET", "DSUM", "DIGRP", "TSTALM", "MSDVDR", "M/A", "M/A-M", "A/M", "ON/OFF", "TREND", "RECIPR", "BMUX", "RMUX", "RDEMUX", "P=0",
    ),
    "io-module": ("DI1SYS", "DO2SYS", "AI5SYS", "AI5FLD", "DI/L", "DO/L", "AO/L", "AI/L"),
}
IO_PREFIX = r"^(RDI\d|RDO\d|AI\d|AO\d|DI\d|DO\d|TAI\d|TAO\d|TCS|DSO\d|TUIN|TUOUT)"
#: Function codes by name, for blocks whose sheet has no trailer entry.
CODES = {
    "A": 2, "ADAPT": 24, "AIS": 132, "AO/L": 30, "AND2": 37, "AND4": 38, "APID": 156, "AS0": 149, "BASBOQ": 138, "BLINK": 61, "BMUX": 119, "CISI/O": 79, "DDRIVE": 123, "DELPID": 19, "DIGDEF": 128, "DIGRP": 84,
    "DIV": 17, "DO/L": 45, "DOGRP": 83, "DSUM": 65, "EEX/MFC": 90, "ETIMER": 86, "EXP": 172, "FT": 3, "FX": 1, "H/L": 12, "HISEL": 10, "INPOL": 168, "INTEGR": 166, "LIMIT": 6, "LOSEL": 11, "M/A-M": 80, "MOVAVG": 165,
    "MSDVDR": 129, "MULT": 16, "NOT": 33, "ON/OFF": 50, "OR2": 39, "OR4": 40, "PID": 18, "PULPOS": 4, "QOR": 36, "RCM": 62, "RDEMUX": 126, "RECIPB": 117, "RECIPR": 118, "REDAI": 96, "REMSET": 68, "RESTR": 140,
    "RMUX": 120, "SEGCRM": 82, "SEQGEN": 161, "SEQMGR": 135, "SEQMON": 124, "SEQMST": 141, "SEQSLV": 142, "SMITH": 160, "SQRT": 7, "SR": 34, "SUM": 15, "SUM4": 14, "T-AN": 9, "T-DIG": 59, "TD-DIG": 35, "TEXT": 151,
    "TREND": 66, "TSTALM": 69, "TSTQ": 31, "UP/DN": 85, "VELLIM": 8, "XOR": 101,
}
#: Families by form of the name; the first that fits counts.
FAMILIES = (
    (r"^(IREF|IREFO)$", "connector-in"), (r"^OREF$", "connector-out"), (r"^N90CNECT$", "junction"), (r"^(AND2|AND4)$", "gate-and"), (r"^(OR|OR2|OR4|QOR)$", "gate-or"), (r"^NOT$", "gate-not"), (r"^(SR|REMSET)$", "latch"),
    (r"^(TD-DIG|ETIMER)$", "timer"), (r"^(T-AN|T-DIG)$", "transfer"), (r"^(H/L|HISEL|LOSEL|TSTALM|TSTQ|LIMIT|VELLIM)$", "alarm-compare"), (r"^(PID|APID|DELPID|ADAPT)$", "controller"),
    (r"^(M/A-M|MFC/P|EX/MFC|EEX/MFC|RCM|DDRIVE|MSDVDR)$", "station"), (r"^(AI/L|AO/L|DI/L|DO/L|AI/B|DI/B|DIGRP|DOGRP)$", "io-block"), (r"^(AIS|AS0)$", "io-slave"),
    (r"^(SUM|SUM4|DSUM|MULT|DIV|SQRT|EXP|FX|INTEGR|A|SEGCRM|BMUX|RMUX|ON/OFF|FT|TEXT)$", "arithmetic"), (r"^(SEQ\w*)$", "sequence"), (r"^(B0|B1|R0|R1|R-1|R100|R-100|RMIN|RMAX)$", "constant"),
    (r"^(RDI\w+|RDO\w+|NTAI\w+|TAI\w+|TAO\w+|\w+SYS|\w+FLD)$", "hardware"), (r"^(DBORDH|LINE|TITLE|REV|BOX1|BOX2)$", "frame"),
)
#: Kinds of block in the engineering model, by form of the name.
BLOCK_TYPES = ((r"SEQ", "SequenceBlock"), (r"^(TD-|T-|ETIMER|P=0)", "TimingBlock"), (r"^(AI|AO|DI|DO|CIS|CISL)", "IOMarker"))


def _name(name: Column) -> Column:
    return F.upper(F.trim(name))


def _first(name: Column, table, rest: str) -> Column:
    found = F.lit(rest)
    for form, kind in reversed(table):
        found = F.when(F.coalesce(name.rlike(form), F.lit(False)), kind).otherwise(found)
    return found


def symbol_role(name: Column) -> Column:
    """border, frame, connector, input-ref, output-ref, logic, io-module or generic; whole names go before forms of names."""
    plain = _name(name)
    found = F.when(F.coalesce(plain.rlike(IO_PREFIX), F.lit(False)), "io-module").otherwise("generic")
    for role, names in reversed(ROLE_NAMES.items()):
        found = F.when(F.coalesce(plain.isin(*names), F.lit(False)), role).otherwise(found)
    return found


def function_code(name: Column) -> Column:
    """The function code of a symbol's name, or null."""
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.try_element_at(codes, _name(name))


def symbol_family(name: Column) -> Column:
    return _first(_name(name), FAMILIES, "generic")


def block_type(name: Column) -> Column:
    """The kind of a block in the engineering model; names aren't trimmed here."""
    return _first(F.upper(name), BLOCK_TYPES, "LogicBlock")
