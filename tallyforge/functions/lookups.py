"""Fixed tables of units, categories, attributes and names, each defined once and given out as Spark maps and as SQL."""

from __future__ import annotations

# Letters whose capitals are several characters, with the one that stands for them: ẞ, a capital with iota, or the letter itself.
_SEVERAL = [chr(c) for c in range(0x10000) if len(chr(c).upper()) > 1]
#: Letters that got a capital with Unicode 16 stay too, whatever the JVM knows.
CAPITALS: dict[str, str] = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL} | {c: c for c in "\u019b\u0264\u1c8a\ua7cd\ua7db"}

# Unit spellings of the value normaliser (None: a known word that is no unit).
UNIT_ALIASES: dict[str, str | None] = {
    "volt": "V", "volts": "V", "vac": "V",
    "kilowatt": "kW", "kilowatts": "kW", "kw": "kW", "watt": "W", "watts": "W", "hp": "HP", "horsepower": "HP",
    "rpm": "RPM", "r/min": "RPM", "rev/min": "RPM",
    "ampere": "A", "amperes": "A", "amp": "A", "amps": "A", "milliampere": "mA", "milliamperes": "mA", "ma": "mA",
    "hertz": "Hz", "hz": "Hz",
    "celsius": "°C", "°c": "°C", "c": "°C", "fahrenheit": "°F", "°f": "°F",
    "bar": "bar", "psi": "PSI", "pa": "Pa", "pascal": "Pa",
    "kg": "kg", "kilogram": "kg", "kilograms": "kg", "gram": "g", "grams": "g", "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb",
    "mm": "mm", "millimeter": "mm", "millimeters": "mm", "cm": "cm", "centimeter": "cm", "centimeters": "cm",
    "m": "m", "meter": "m", "meters": "m", "in": "in", "inch": "in", "inches": "in",
    "liter": "L", "liters": "L", "l": "L",
    "ip": None, "%": "%", "percent": "%", "": None,
}

# Words for true and false.
TRUE_WORDS = ["yes", "true", "1", "on", "enabled", "available", "included", "yes/included"]
FALSE_WORDS = ["no", "false", "0", "off", "disabled", "unavailable", "excluded", "n/a"]

# Factors to the base unit, by upper-case unit (MV is millivolt, MW megawatt).
SI_UNITS: dict[str, tuple[float, str]] = {
    "W": (1.0, "W"), "WATTS": (1.0, "W"), "WATT": (1.0, "W"), "KW": (1000.0, "W"), "KILOWATT": (1000.0, "W"), "KILOWATTS": (1000.0, "W"),
    "MW": (1000000.0, "W"), "HP": (745.7, "W"), "HORSEPOWER": (745.7, "W"),
    "V": (1.0, "V"), "VOLT": (1.0, "V"), "VOLTS": (1.0, "V"), "VAC": (1.0, "V"), "KV": (1000.0, "V"), "MV": (0.001, "V"),
    "HZ": (1.0, "Hz"), "HERTZ": (1.0, "Hz"), "KHZ": (1000.0, "Hz"), "MHZ": (1000000.0, "Hz"),
    "KG": (1.0, "kg"), "KILOGRAM": (1.0, "kg"), "KILOGRAMS": (1.0, "kg"), "G": (0.001, "kg"), "GRAM": (0.001, "kg"), "GRAMS": (0.001, "kg"),
    "LB": (0.45359237, "kg"), "LBS": (0.45359237, "kg"), "POUND": (0.45359237, "kg"),
    "M": (1.0, "m"), "METER": (1.0, "m"), "METERS": (1.0, "m"), "CM": (0.01, "m"), "CENTIMETER": (0.01, "m"), "MM": (0.001, "m"), "MILLIMETER": (0.001, "m"),
    "IN": (0.0254, "m"), "INCH": (0.0254, "m"), "INCHES": (0.0254, "m"),
    "RPM": (1.0, "RPM"), "R/MIN": (1.0, "RPM"), "REV/MIN": (1.0, "RPM"),
}

# Unit synonyms of the unit check.
UNIT_SYNONYMS: dict[str, str] = {
    "w": "W", "watt": "W", "watts": "W", "kw": "kW", "kilowatt": "kW", "kilowatts": "kW", "mw": "MW", "megawatt": "MW", "megawatts": "MW", "hp": "HP", "horsepower": "HP",
    "v": "V", "volt": "V", "volts": "V", "kv": "kV", "kilovolt": "kV", "kilovolts": "kV", "mv": "mV", "millivolt": "mV",
    "rpm": "RPM", "r.p.m.": "RPM", "revolutions/min": "RPM", "rev/min": "RPM", "1/min": "RPM",
    "g": "g", "gram": "g", "grams": "g", "kg": "kg", "kilogram": "kg", "kilograms": "kg", "t": "t", "ton": "t", "tonne": "t", "tonnes": "t",
    "lb": "lbs", "lbs": "lbs", "pound": "lbs", "pounds": "lbs",
    "hz": "Hz", "hertz": "Hz", "khz": "kHz", "kilohertz": "kHz", "mhz": "MHz",
    "a": "A", "amp": "A", "amps": "A", "ampere": "A", "amperes": "A", "ma": "mA", "milliamp": "mA", "ka": "kA",
    "°c": "°C", "c": "°C", "celsius": "°C", "°f": "°F", "f": "°F", "fahrenheit": "°F", "k": "K", "kelvin": "K",
    "bar": "bar", "psi": "PSI", "kpa": "kPa", "mpa": "MPa",
    "m3/h": "m³/h", "m³/h": "m³/h", "l/min": "L/min", "gpm": "GPM",
    "m": "m", "meter": "m", "meters": "m", "mm": "mm", "millimeter": "mm", "millimeters": "mm", "cm": "cm", "centimeter": "cm",
    "in": "in", "inch": "in", "inches": "in", "ft": "ft", "feet": "ft",
}

# Units that fit a concept; the order of the concepts decides.
CONCEPT_UNITS: dict[str, list[str]] = {
    "voltage": ["V", "kV", "mV"],
    "power": ["W", "kW", "MW", "HP"],
    "power_rating": ["VA", "kVA", "MVA", "W", "kW", "MW", "HP"],
    "speed": ["RPM"],
    "weight": ["g", "kg", "t", "lbs"],
    "frequency": ["Hz", "kHz", "MHz"],
    "current": ["A", "mA", "kA"],
    "temperature": ["°C", "°F", "K"],
    "pressure": ["bar", "PSI", "kPa", "MPa"],
    "flow_rate": ["m³/h", "L/min", "GPM"],
    "head": ["m", "ft"],
    "length": ["m", "mm", "cm", "in", "ft"],
    "height": ["m", "mm", "cm", "in", "ft"],
    "width": ["m", "mm", "cm", "in", "ft"],
    "depth": ["m", "mm", "cm", "in", "ft"],
}

# Further words for a concept, in order.
CONCEPT_WORDS: list[tuple[list[str], str]] = [
    (["voltage", "volt"], "voltage"),
    (["power", "kw", "watt"], "power"),
    (["speed", "rpm"], "speed"),
    (["weight", "mass"], "weight"),
    (["freq"], "frequency"),
    (["current", "amp"], "current"),
]

# Fixed values: (required, optional) attributes of a category; the order decides between partial matches.
CATEGORY_RULES: dict[str, tuple[list[str], list[str]]] = {
    "industrial_motor": (["voltage", "power", "speed"], ["weight", "efficiency", "frequency", "phase", "current", "frame_size", "insulation_class", "ip_rating"]),
    "motor": (["voltage", "power", "speed"], ["weight", "efficiency", "frequency", "phase"]),
    "pump": (["flow_rate", "head", "power"], ["speed", "pressure", "weight", "material"]),
    "transformer": (["primary_voltage", "secondary_voltage", "power_rating"], ["frequency", "weight", "cooling_type"]),
    "generic": ([], ["weight", "voltage", "power", "dimensions"]),
}

# Names that count as an attribute.
ATTRIBUTE_ALIASES: dict[str, list[str]] = {
    "voltage": ["voltage", "rated_voltage", "operating_voltage", "supply_voltage", "primary_voltage", "secondary_voltage"],
    "power": ["power", "rated_power", "power_rating", "motor_power", "output_power"],
    "speed": ["speed", "rated_speed", "operating_speed", "rotation_speed", "no_load_speed"],
    "frequency": ["frequency", "rated_frequency", "line_frequency", "operating_frequency"],
    "current": ["current", "rated_current", "full_load_current", "operating_current"],
    "phase": ["phase", "number_of_phases", "phase_count"],
    "weight": ["weight", "gross_weight", "net_weight"],
    "efficiency": ["efficiency", "motor_efficiency", "energy_efficiency"],
    "ip_rating": ["ip_rating", "protection_rating", "enclosure_rating", "ip_class"],
}

# Unit spellings of part lists.
PART_UNITS: dict[str, str] = {
    "inches": "in", "inch": "in", "in.": "in", "in": "in", "feet": "ft", "foot": "ft", "ft.": "ft", "ft": "ft",
    "volts": "V", "volt": "V", "v": "V", "amps": "A", "amp": "A", "a": "A",
    "decibels": "dBA", "decibel": "dBA", "dba": "dBA", "db": "dBA", "hertz": "Hz", "hz": "Hz", "rpm": "RPM", "cfm": "CFM", "psi": "PSI",
    "degree": "°", "degrees": "°", "deg": "°", "celsius": "°C", "c": "°C", "f": "°F", "fahrenheit": "°F",
    "pc": "pc", "pcs": "pc", "pack": "pk", "pk": "pk", "box": "box", "disc": "disc", "discs": "disc",
}

# Manufacturers with brand and code, in order.
MANUFACTURERS: list[tuple[str, str, str]] = [
    ("Freud Inc", "Diablo®", "2435"),
    ("3M Company", "3M™", "JAMIN"),
    ("Jam Industrial Supply LLC", "3M™", "JAMIN"),
    ("Mirka Abrasives Inc", "Mirka®", "MIRKA"),
    ("Milwaukee Accessory", "Milwaukee®", "MILW"),
    ("Emseal Joint Systems Ltd", "Emseal™", "EMSEAL"),
    ("Appliance Dealers Cooperative", "Frigidaire®", "APPDE"),
    ("V & V Appliance Parts Inc", "Whirlpool®", "VVAP"),
    ("Wera Tools NA Inc", "Wera®", "WERA"),
    ("U S Lumber", "Trex®", "USLUM"),
    ("Boise Cascade Building Materials", "Trex®", "BOISE"),
    ("Parksite", "TimberTech®", "PARKSITE"),
    ("Velux America LLC", "Velux®", "VELUX"),
    ("Provia LLC", "Provia®", "PROVIA"),
    ("James Hardie Building Products", "James Hardie®", "HARDIE"),
    ("Huber Engineered Woods", "Huber®", "HUBER"),
    ("Leviton Manufacturing Co Inc", "Leviton®", "LEVITON"),
    ("General Electric Company", "GE®", "GE"),
    ("LG Electronics Inc", "LG®", "LG"),
    ("Speed Queen Company", "Speed Queen®", "SQ"),
]

# Names that stand for no manufacturer or brand.  Lists that have names of their own for it add them where they are looked up.
PLACEHOLDERS = ["", "-", "--", "-- unbranded --", "unbranded", "no brand", "none", "n/a", "null", "undefined"]

# Approved class paths, in order.
CLASS_PATHS = [
    "Appliances & Consumer Electronics>Kitchen Appliances>Built-In Dishwashers",
    "Appliances & Consumer Electronics>Laundry Appliances>Dryers",
    "Appliances & Consumer Electronics>Laundry Appliances>Washing Machines",
    "Abrasives>Sanding & Grinding>Sanding Belts",
    "Abrasives>Sanding & Grinding>Sanding Discs",
    "Abrasives>Sanding & Grinding>Cut-Off Wheels",
    "Building Materials>Decking & Railing>Deck Boards",
    "Building Materials>Decking & Railing>Railing Kits",
    "Building Materials>Joint Tapes & Sealants>Expansion Joints",
    "Tools & Hardware>Hand Tools>Kneeling Pads",
    "Building Materials>Drywall & Plastering>Drywall Sheets",
    "Building Materials>Siding & Trim>Siding Panels",
    "Electrical & Lighting>Wiring Accessories>Electrical Tape",
    "Electrical & Lighting>Power Distribution>Box Covers",
]


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_map(entries: dict[str, str | None]) -> str:
    """A DuckDB map literal."""
    return "MAP {" + ", ".join(f"{sql_text(k)}: {sql_text(v)}" for k, v in entries.items()) + "}"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"
