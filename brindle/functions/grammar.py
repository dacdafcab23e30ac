"""How titles state what they state, as a table: each attribute's forms in order of preference.

A form is a shape of a folded title and what is written for it, with the shape's slots by number. The
shapes are put together from slots: words, one of several words, numbers of so many digits, codes.
Between slots there may be blanks and a hyphen.
"""

from __future__ import annotations

import re

Form = tuple[str, str]
GAP = r"[\s-]*"


def word(*names: str) -> str:
    """One of the names, which is not written."""
    return "(?:" + "|".join(map(re.escape, names)) + ")"


def one(*names: str) -> str:
    """One of the names, which is a slot; the first that fits, so longer ones come first."""
    return "(" + "|".join(map(re.escape, names)) + ")"


def num(low: int, high: int | None = None, tail: str = "") -> str:
    """A number of so many digits, with what may stand behind it, as a slot."""
    return rf"(\d{{{low},{high or low}}}{tail})"


def maybe(slot: str) -> str:
    return rf"(?:{GAP}{slot})?"


def shape(*slots: str, end: str = r"\b") -> str:
    """Slots in a row; optional ones bring their own gap."""
    out = r"\b"
    for i, slot in enumerate(slots):
        out += ("" if i == 0 or slot.startswith("(?:" + GAP) else GAP) + slot
    return out + end


def forms(*rows: tuple[str, str]) -> tuple[Form, ...]:
    return rows


def just(pattern: str) -> tuple[Form, ...]:
    """What the pattern's one slot holds."""
    return (("{0}", pattern),)


_TIER = one("3", "5", "7", "9")
_SUFFIXED = r"[a-z0-9]{0,4}"
_WATT = word("watts", "watt", "w")

GRAMMAR: dict[str, tuple[Form, ...]] = {
    # chips
    "gpu_model": forms(("{0}{1}{2}", shape(one("rtx", "gtx"), num(3, 4), maybe(one("ti super", "ti", "super")))), ("rx{0}{1}", shape(word("rx"), num(3, 4), maybe(one("xtx", "xt", "gre"))))),
    "processor": forms(
        ("i{0}-{1}", shape("i" + _TIER, rf"(\d{{4,5}}{_SUFFIXED}|n\d{{3}}[a-z]*)")),
        ("core{0}-{1}", shape(word("core"), _TIER + r"\s", num(3, 3, "[a-z]*"))),
        ("coreultra{0}-{1}", shape(word("core ultra"), _TIER, num(3, 5, "[a-z]{0,3}"))),
        ("ryzen{0}-{1}", shape(word("ryzen", "r"), _TIER, num(4, 5, _SUFFIXED))),
    ),
    "socket": just(shape(r"(?:socket\s*)?(am\s*\d+|swrx\d+|sp\d+|lga\s*\d{3,4})")),
    "vram": forms(("{0}gb", shape(one("8", "10", "12", "16", "20", "24") + r"\s*g(?:b|ddr\d?)?"))),
    "memory_type": forms(("gddr{0}", shape(word("gddr"), r"([567]x?)")), ("ddr{0}", shape(word("ddr"), one("4", "5")))),
    "ddr": forms(("ddr{0}", shape(word("ddr"), one("4", "5")))),
    # phones, boards, drives
    "phone": forms(
        ("iphone{0}{1}", shape(word("iphone"), r"(1[0-9]e?|[6-9]e?)", maybe(r"(pro\s*max|pro|plus)"))),
        ("galaxyz{0}{1}", shape(word("galaxy z", "galaxyz"), one("fold", "flip"), num(1, 2))),
        ("galaxy{0}{1}{2}", shape(word("galaxy"), one("note", "s", "a", "m", "f"), num(1, 2), maybe(r"(ultra|plus|\+|fe)"), end="")),
    ),
    "board": forms(
        ("{0}{1}", r"\b([abzhx]\d{3}m?)\s*-\s*([a-z0-9]+)\b"),
        ("{0}{1}", r"\b([abzhx]\d{3}m?)\s+(?!am[45]\b|ddr[345]\b)([a-z]{1,4}\d[a-z0-9]{0,3}|[a-z])(?:\s+v\d+)?\b"),
        ("{0}{1}", shape(r"([abzhx]\d{3}m?)", maybe(one("plus", "pro", "iii", "ii", "i", "a", "e", "f")))),
    ),
    "series": forms(("{0}{1}", shape(r"([89]\d0)", r"(evo\s*plus|evo\s*pro|pro|evo)"))),
    "monitor_code": just(r"\b((?:[a-z]{1,3}\d{2}[a-z][a-z0-9]{0,8}|\d{2}[a-z]{2}\d{2,4}[a-z0-9]*)(?:-[a-z0-9]+)?)\b"),
    # power, consoles
    "wattage": forms(("{0} w", shape(r"0*(\d{3,4})", _WATT))),
    "small_wattage": just(r"\b(\d{2,4})\s*w\b"),
    "efficiency": forms(("80 plus {0}", shape(word("80"), r"(?:plus|\+)", one("white", "bronze", "silver", "gold", "platinum", "titanium")))),
    "psu_model": just(r"(?<![a-z0-9])([a-z]{1,5}\d{3,5}[a-z0-9]*)(?![a-z0-9])"),
    "modularity": forms(("semi", shape(word("semi"), word("modular"))), ("full", shape(word("modular")))),
    "console": forms(("playstation 5", shape(word("playstation", "ps"), "5")), ("playstation 4", shape(word("playstation", "ps"), "4")), ("xbox series x", shape(word("xbox series x"))), ("xbox series s", shape(word("xbox series s"))), ("nintendo switch", shape(word("nintendo switch")))),
    "disc": forms(("digital", shape(word("digital"))), ("disc", r"\bdisc\b|\bblu-?ray\b|\boptical\b|\bedicao\s+(?:fisica|disco)\b")),
    "fifth": forms(("5", r"\b(?:playstation|ps)\s*5\b|\bcfi-?\d")),
    "controllers": forms(("{0}", shape(one("1", "2", "3", "4"), r"(?:controles?|controllers?|dualsense)")), ("2", r"\b(?:dois|two)\s+controles?\b|\bdualsense\s*x\s*2\b"), ("1", r"\b(?:um|one)\s+controle\b")),
    # displays
    "screen_size": just(r"\b(\d{2}(?:[.,]\d)?)\s*(?:\"|''|in\b|inch|pol)"),
    "resolution": forms(("{0}x{1}", r"\b(\d{3,4})\s*x\s*(\d{3,4})\b"), ("3840x2160", r"\b(?:4k|uhd)\b"), ("2560x1440", r"\b(?:qhd|wqhd|2k)\b"), ("1920x1080", r"\b(?:full hd|fhd)\b")),
    "refresh_rate": just(r"\b(\d{2,3})\s*hz\b"),
    "panel": forms(("oled", r"\boled\b"), ("qled", r"\bqled\b"), ("mini-led", r"\bmini-?led\b"), ("ips", r"\bips\b"), ("va", r"\bva\b"), ("tn", r"\btn\b")),
    # carriers
    "carrier": forms(("verizon", r"\bverizon\b"), ("at&t", r"\bat\s*&\s*t\b|\batt\b"), ("t-mobile", r"\bt[\s-]?mobile\b")),
    "lock": forms(("unlocked", r"\b(?:unlocked|desbloquead[oa]|liberad[oa])\b"), ("locked", r"\b(?:locked|bloquead[oa])\b")),
    # parts and their looks
    "interface": forms(("nvme", r"\bnvme\b"), ("sata", r"\bsata\b"), ("usb", r"\busb\b"), ("bluetooth", r"\bbluetooth\b")),
    "pcie_generation": just(r"\bpcie\s*(?:gen)?\s*(\d(?:\.\d)?)"),
    "frequency": just(r"\b(\d{3,5})\s*(?:mhz|mt/s)"),
    "cas_latency": just(r"\bcl\s*(\d{2})\b"),
    "kit": just(r"\b(\d\s*x\s*\d{1,3})\s*gb\b"),
    "form_factor": forms(("mini-itx", r"\b(?:mini-)?itx\b"), ("micro-atx", r"\b(?:micro-?atx|m-?atx)\b"), ("e-atx", r"\be-?atx\b"), ("atx", r"\batx\b"), ("sodimm", r"\bso-?dimm\b"), ("m.2", r"\bm\.2\b")),
    "wifi": forms(("wifi {0}", r"\bwi-?fi\s*(7|6e|6|5)\b"), ("wifi", r"\bwi-?fi\b|\bwireless\b")),
    "cooler_type": forms(("liquid", r"\b(?:water\s*cooler|liquid|liquido|aio)\b"), ("air", r"\bair\b|\bnh-|\bak\d")),
    "radiator_size": just(r"\b(120|140|240|280|360|420)\s*(?:mm)?\b"),
    "fan_size": just(r"\b(80|92|120|140|200)\s*mm\b"),
    "fan_count": just(r"\b(\d)\s*(?:fans|ventoinhas|pack)\b"),
    "rgb": forms(("argb", r"\bargb\b"), ("rgb", r"\brgb\b")),
    "tablet": forms(("ipad{0}", r"\bipad(?:\s*(pro|air|mini)\b|\b)")),
    "connectivity": forms(("wireless", r"\b(?:wireless|sem fio|bluetooth|inalambrico)\b"), ("wired", r"\b(?:wired|com fio|usb)\b")),
    "cellular": forms(("cellular", r"\b(?:cellular|5g|4g|lte)\b")),
    "switch_type": forms(("red", r"\bswitch (?:red|vermelho)\b"), ("brown", r"\bswitch (?:brown|marrom)\b"), ("blue", r"\bswitch (?:blue|azul)\b")),
    "layout": forms(("abnt2", r"\babnt2\b"), ("us", r"\blayout us\b")),
    "dpi": just(r"\b(\d{3,5})\s*dpi\b"),
    "port_count": just(r"\b(\d{1,2})\s*(?:portas?|ports?)\b"),
    "port_speed": just(r"\b(\d+(?:\.\d)?)\s*gb(?:ps|e)\b"),
    "poe": forms(("poe", r"\bpoe\b")),
    "print_technology": forms(("laser", r"\blaser(?:jet)?\b"), ("ink", r"\b(?:ecotank|jato de tinta|inkjet)\b")),
    "fps": just(r"\b(\d{2,3})\s*fps\b"),
    "channels": just(r"\b(\d\.\d(?:\.\d)?)\s*(?:canais|channels|ch)?\b"),
    "brightness": just(r"\b(\d{3,5})\s*lumens?\b"),
    "case_size": just(r"\b(3[89]|4[0-9])\s*mm\b"),
    "mount": forms(("ef", r"\bef-?s?\b"), ("rf", r"\brf\b"), ("e-mount", r"\be-mount\b"), ("z", r"\bnikkor z\b")),
    "focal_length": just(r"\b(\d{1,3}(?:-\d{1,3})?)\s*mm\b"),
    "bay_count": just(r"\b(\d)\s*(?:baias?|bays?|-bay)\b"),
    "va": just(r"\b(\d{3,5})\s*va\b"),
    "thunderbolt": just(r"\bthunderbolt\s*(\d)\b"),
    "standard": just(r"\b(?:hdmi|displayport|usb)\s*(\d\.\d)\b"),
    "length": just(r"\b(\d+(?:\.\d+)?)\s*m(?:etros?)?\b"),
    "ethernet_category": just(r"\bcat\.?\s*(\d[ae]?)\b"),
    "vesa": just(r"\bvesa\b.*?\b(\d{2,3}x\d{2,3})\b"),
    "arm_count": just(r"\b(\d)\s*(?:monitores|monitors|bracos|arms)\b"),
    "width": just(r"\b(\d{2,3})\s*cm\b"),
}
