"""Fixed values of the layout rules: vocabularies, palettes, patterns and tolerances.

They are data, not tuning: results depend on them exactly, and the order of a vocabulary is part of it.
"""

from __future__ import annotations

MM_PER_PT = 25.4 / 72

# Colours of annotations and the inclusive tolerance of each channel.
ANNOTATION_COLORS = ["#0000ff", "#0000cd", "#0054a6", "#0091d2", "#1a73e8", "#196ea6", "#1a6ea6", "#3373a8"]
COLOR_TOLERANCE = 24

# The shape of a dimension text, lone arrows, and the shape of a possible production mark.
DIMENSION_PATTERN = r"(?i)^\s*[\d.]+\s*mm\s*$"
ARROWS = ["◄", "►", "▲", "▼", "←", "→", "↑", "↓", "◀", "▶"]
MARK_SHAPE = r"^[A-Za-z][A-Za-z0-9 .:/\-]{2,28}$"

# Production marks, and how much longer than its term a mark may be.
MARK_TERMS = [
    "pasting side", "stereo print", "stereo", "die line", "dieline", "die cut", "cut line", "cutline", "crease line",
    "fold line", "bleed line", "trim line", "varnish", "varnish free", "no varnish", "matt varnish", "gloss varnish",
    "spot uv", "overprint", "emboss", "debossing", "hot foil", "foil stamp", "kiss cut", "tuck flap", "glue flap",
    "gusset", "reverse side", "inner side", "outer side", "non printing area", "not to scale", "scale 1:1",
]
MARK_SUFFIX = 4

# Characters that stand for ligatures and symbols, in order of replacement.
LIGATURES = [
    ("Ɵ", "ti"), ("Ō", "ft"), ("⁰", "°"), ("ƞ", "tf"), ("ơ", "tí"), ("İ", "fí"), ("Ʃ", "tt"),
    ("Ÿ", "•"), (" ", " "), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
]

# Words with a dropped glyph (U+FFFD) and what they are, in order of replacement.
KNOWN_WORDS = [
    ("ce\ufffdriaxona", "ceftriaxona"), ("Ce\ufffdriaxona", "Ceftriaxona"), ("ce\ufffdriaxone", "ceftriaxone"), ("Ce\ufffdriaxone", "Ceftriaxone"),
    ("Bo\ufffdom", "Bottom"), ("bo\ufffdom", "bottom"), ("a\ufffdached", "attached"), ("A\ufffdached", "Attached"), ("di\ufffdcil", "difícil"), ("Di\ufffdcil", "Difícil"),
    ("con\ufffdene", "contiene"), ("Con\ufffdene", "Contiene"), ("pharmaceu\ufffdcals", "pharmaceuticals"), ("Pharmaceu\ufffdcals", "Pharmaceuticals"),
    ("úl\ufffdmo", "último"), ("e\ufffdqueta", "etiqueta"), ("me\ufffdlo", "metilo"), ("ac\ufffdvo", "activo"), ("ac\ufffdva", "activa"),
    ("an\ufffdhelmín\ufffdco", "antihelmíntico"), ("Vida ú\ufffdl", "Vida útil"), ("sus\ufffdtución", "sustitución"), ("garan\ufffdza", "garantiza"),
    ("iden\ufffdficar", "identificar"), ("inves\ufffdgar", "investigar"), ("efe\ufffdvos", "efectivos"), ("Ges\ufffdón", "Gestión"), ("can\ufffddad", "cantidad"),
    ("repe\ufffdr", "repetir"), ("par\ufffdcular", "particular"), ("compa\ufffdble", "compatible"), ("mul\ufffdplicar", "multiplicar"), ("alterna\ufffdva", "alternativa"),
    ("Alterna\ufffdva", "Alternativa"), ("obje\ufffdvo", "objetivo"), ("sen\ufffddo", "sentido"), ("intes\ufffdnal", "intestinal"), ("Intes\ufffdnal", "Intestinal"),
    ("adver\ufffdda", "advertida"), ("sor\ufffdtol", "sorbitol"), ("Sor\ufffdtol", "Sorbitol"), ("Prin\ufffdng", "Printing"), ("prin\ufffdng", "printing"),
    ("Prin\ufffdng Overlay", "Printing Overlay"), ("Prin\ufffdng Zone", "Printing Zone"), ("Non Prin\ufffdng Area", "Non Printing Area"),
    ("Pas\ufffdng Side", "Pasting Side"), ("pas\ufffdng side", "pasting side"), ("de \ufffdtanio", "de Titanio"), ("De \ufffdtanio", "De Titanio"),
    ("\ufffdtanio", "Titanio"), ("\ufffdtanio Dióxido", "Titanio Dióxido"), ("\ufffdstulas", "fístulas"), ("\ufffdstula", "fístula"), ("F\ufffdstulas", "Fístulas"),
    ("pancrea\ufffd\ufffds", "pancreatitis"), ("Pancrea\ufffd\ufffds", "Pancreatitis"), ("derma\ufffd\ufffds", "dermatitis"), ("Derma\ufffd\ufffds", "Dermatitis"),
    ("estoma\ufffd\ufffds", "estomatitis"), ("Estoma\ufffd\ufffds", "Estomatitis"), ("hepa\ufffd\ufffds", "hepatitis"), ("Hepa\ufffd\ufffds", "Hepatitis"),
]

# Runs that GBK makes of UTF-8 bytes, and what a repaired run may hold.
FOREIGN = "[\u3000-\u303f\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef]+"
PLAUSIBLE = r"^[\u0000-\u024f\u2000-\u20cf\u2122]+$"

# Characters beyond ASCII that belong in a text.
EXPECTED = "ÁÉÍÓÚÜÑáéíóúüñ¿¡ºª°±®©‘’“”–—…·€\u00a0•çãâõö«»≤≥αβγµ™"

# What is cut from a font's name, in order, and the words in it that mean bold or slanted.
FONT_SUFFIXES = ["-Bold", "-Italic", "-BoldItalic", "-Regular", "Bold", "Italic", "Regular", "Light", "Medium", "-MT", "MT", "-PS", "PS"]
BOLD_WORDS, ITALIC_WORDS = ["bold", "black", "heavy", "demi"], ["italic", "oblique", "slant"]

# Header labels and their canonical names (substring of the label key).
HEADER_LABELS = [
    ("product name", "product name"), ("ac reference", "ac reference"), ("ac ref", "ac reference"), ("component type", "component type"),
    ("substrate", "substrate"), ("pantone no", "pantone no"), ("artwork size", "artwork size"), ("flat size", "flat size"),
    ("print side", "print side"), ("colour code", "colour code"), ("color code", "colour code"), ("market", "market"), ("version", "version"),
    ("dimension", "dimension"), ("size in mm", "dimension"), ("size lxw", "dimension"), ("size lxwxh", "dimension"),
]
HEADER_MIN_LABELS, SEED_GAP_MM, HEADER_FALLBACK, HEADER_PAD_PT, PITCH_TOLERANCE, HEADER_MAX_EXTENT = 2, 50.0, 0.20, 6.0, 1.8, 0.45

# Labels of reconstructed header tables, in order of preference.
FIELD_LABELS = [
    ("product name", "product_name"), ("ac reference", "ac_reference"), ("ac ref", "ac_reference"), ("component type", "component_type"),
    ("substrate", "substrate"), ("pantone no", "pantone_no"), ("artwork size", "artwork_size"), ("flat size", "flat_size"), ("print side", "print_side"),
    ("printing side", "print_side"), ("colour code", "colour_code"), ("color code", "colour_code"), ("market", "market"), ("version", "version"),
    ("dimension", "dimension"), ("size in mm", "dimension"), ("size lxw", "dimension"), ("size lxh", "dimension"), ("size lxwxh", "dimension"),
    ("size (w)", "dimension"), ("size", "dimension"), ("product code", "product_code"), ("style", "style"), ("barcode", "barcode"),
    ("printing overlay", "printing_overlay"), ("repeat outer", "repeat_outer"), ("repeat", "repeat"), ("printing zone", "printing_zone"),
    ("dia of tube", "dia_of_tube"), ("presentation", "presentation"), ("shelf life", "shelf_life"),
]

# The composite reference, row band, value shapes and edge margin.
AC_PATTERN = r"(?i)\bAC\s*(\d+)\s*V\.?\s*(\d+)\b"
ROW_BAND_PT, AC_EDGE_MM = 6.0, 15.0
NUMBER_SHAPE, VERSION_SHAPE = r"^(?:\d+)$", r"^(?:[\d.]+)$"
DIMENSION_TOLERANCE_MM, SHEET_TOLERANCE_MM = 0.5, 1.0
DIMENSION_NUMBER = r"\d+(?:\.\d+)?"
DIMENSION_SHAPE = r"(?i)^[\d.]+(?:\s*[x×]\s*[\d.]+){1,2}\s*(?:mm)?$"
INLINE_VALUE = r"(\d[\d.\-/]*)\s*$"

# EAN-13 left odd, left even and right codes of 0 to 9, and the parity rows of the first digit.
EAN_L = ["0001101", "0011001", "0010011", "0111101", "0100011", "0110001", "0101111", "0111011", "0110111", "0001011"]
EAN_G = ["0100111", "0110011", "0011011", "0100001", "0011101", "0111001", "0000101", "0010001", "0001001", "0010111"]
EAN_R = ["1110010", "1100110", "1101100", "1000010", "1011100", "1001110", "1010000", "1000100", "1001000", "1110100"]
EAN_FIRST = ["000000", "001011", "001101", "001110", "010011", "011001", "011100", "010101", "010110", "011010"]
EAN_MODULES, EAN_MIN_BARS, EAN_MODULE_MM = 95, 20, 0.33
BAR_MIN_PT, BAR_TOP_PT, BAR_GAP = 4.0, 1.0, 12.0

# Zones, reading order, segments, grids, panels, blocks and callouts (pt or mm as named).
ZONE_FOLD, ZONE_MIN_PT, ZONE_Y_PT = 0.30, 20.0, 12.0
COLUMN_PT, SPACING_TOLERANCE, SEGMENT_GAP = 40.0, 0.25, 2
GRID_EPS_PT, GRID_LINE_PT, BAND_PAD_PT, BAND_OVERLAP, ROW_PT = 0.5, 5.0, 20.0, 0.8, 8.0
PANEL_MIN_MM, NEST_MM, CALLOUT_THIN_MM, CALLOUT_AREA_MM2 = 3.0, 0.5, 0.5, 25.0
PANEL_ROW_MM, GUTTER_MM, BLOCK_GAP_MM, BODY_FACE, FACE_MM = 2.0, 2.0, 2.5, 0.45, 1.0
TABLE_EPS_MM, TABLE_LINE_MM, LINE_EPS_MM, MATCH_MM = 0.3, 2.0, 0.6, 0.5
OUTLINED_PATHS = 120
INFERRED_SPANS = 2
SMALL_FONT, RAISED_PT = 0.82, 0.3

# Legends and the phrases that name them, in order; warnings; patterns.
LEGENDS = [
    ("composition", ["composicion:", "composition:", "composicion "]), ("route_of_administration", ["via de administracion:", "route of administration:"]),
    ("storage", ["almacenamiento:", "storage:", "conservar en un lugar seco", "store in a dry place"]),
    ("pediatric_warning", ["producto medicinal, mantengase fuera", "medicinal product, keep out of reach"]),
    ("additional_info", ["para informacion adicional:", "for additional information:", "forma de preparacion:", "method of preparation:"]),
    ("prescription_note", ["venta bajo prescripcion medica", "sale under medical prescription"]), ("otc_note", ["producto de venta libre", "over-the-counter product"]),
    ("hospital_use", ["uso hospitalario", "for hospital use"]), ("batch_coding", ["codigo", "code ", "lote no", "lot no", "fecha fab", "mfg. date"]),
    ("registration_numbers", ["registro sanitario", "registration no"]), ("manufacturer_address", ["fabricado en la india por", "manufactured in india by"]),
    ("route_short", ["para uso oral", "para uso i.m", "para uso i.v", "para uso topico", "para uso oftalmico", "para uso otico", "para uso nasal", "para uso vaginal", "para uso rectal", "for oral use", "for im use", "for iv use", "for im/iv use", "for topical use", "for ophthalmic use"]),
    ("stereo_print", ["stereo print"]), ("equivalence", ["eq. a ", "eq. to "]), ("reconstitution_note", ["despues de reconstituido", "discard any remaining portion"]),
    ("tube_closure_note", ["mantenga el tubo bien cerrado", "keep the tube tightly closed"]), ("external_use_note", ["solo para uso externo", "for external use only"]),
    ("shake_note", ["agitese antes de usar", "shake before use"]),
]
WARNINGS = [
    "aspartame", "tartrazina", "tartrazine", "alcohol bencilico", "bencilic alcohol", "benzyl alcohol", "tetraciclinas", "tetracyclines",
    "acido acetil salicilico", "acetil salicilic acid", "acetaminofen", "acetaminophen", "gluten", "lactosa", "lactose", "sodio", "sodium", "opio", "opium",
]
#: {house} is the manufacturer's trade word, a parameter.
LEGEND_PATTERNS = [
    ("trade_name", r"{house}(?!\s+(?:pharmaceuticals|llp))\s*[\d.]+\s*(?:mg|mcg|g|ml|iu|%)"), ("ac_reference", r"\bac\s*\d+\s*v\.?\s*\d+\b"),
    ("unit_of_dosage", r"^\d+\s*(?:tabletas|tablets|capsulas|capsules|viales|vials|sobres|sachets|ampollas|ampoules|comprimidos|g|kg)\b"),
    ("container_volume", r"^\d+\s*ml\b"), ("route_short", r"\bpara uso [a-z.]+|\bfor [a-z./]+ use\b"),
    ("insert_section", r"^\d+\.\s+(?:que |como |posibles |contenido |conservacion)"), ("shelf_life", r"\bvida util\b|\bshelf life\b"),
]
