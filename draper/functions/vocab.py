"""Vocabularies and rule constants. Results depend on them and on their order."""

SLEEVES = ["sleeveless", "short", "medium", "long", "not_long", "na"]
LENGTHS = ["three_point", "medium_short", "three_quarter", "long", "na"]
NECKLINES = ["v_shape", "square", "round", "standing", "lapel", "suspenders", "na"]
FABRICS = ["denim", "cotton", "leather", "furry", "knitted", "chiffon", "other", "na"]
PATTERNS = ["floral", "graphic", "striped", "pure_color", "lattice", "color_block", "other", "na"]
#: Annotation codes, in code order.
SHAPE_CODES = {
    "sleeve_length": SLEEVES, "lower_length": LENGTHS, "socks": ["no", "socks", "leggings", "na"], "hat": ["no", "yes", "na"],
    "glasses": ["no", "eyeglasses", "sunglasses", "in_hand_or_clothes", "na"], "neckwear": ["no", "yes", "na"],
    "wrist": ["no", "yes", "na"], "ring": ["no", "yes", "na"], "waist_accessory": ["no", "belt", "clothing", "hidden", "na"],
    "neckline": NECKLINES, "cardigan": ["yes", "no", "na"], "navel_covered": ["no", "yes", "na"],
}
PATTERN_CODES = ["floral", "graphic", "striped", "pure_color", "lattice", "other", "color_block", "na"]
SLOTS = ["upper", "outer", "lower", "dress", "romper", "footwear", "headwear", "neckwear", "eyewear", "bag", "belt", "socks", "gloves", "jewelry", "other"]
SWAPPABLE = ["upper", "lower", "outer", "dress", "footwear"]
ACCESSORIES = ["headwear", "neckwear", "eyewear", "bag", "belt", "gloves", "jewelry"]
DOMINANT = ["dress", "romper", "outer"]
CORE = ["upper", "lower", "dress", "romper"]
NEUTRAL = ["black", "white", "gray", "beige", "brown", "navy"]
#: Name -> RGB; the first twelve are the hue families.
REFERENCE_RGB = {
    "red": (255, 0, 0), "orange": (255, 128, 0), "yellow": (255, 255, 0), "chartreuse": (128, 255, 0), "green": (0, 255, 0),
    "spring_green": (0, 255, 128), "cyan": (0, 255, 255), "azure": (0, 128, 255), "blue": (0, 0, 255), "violet": (128, 0, 255),
    "magenta": (255, 0, 255), "rose": (255, 0, 128), "black": (0, 0, 0), "white": (255, 255, 255), "gray": (128, 128, 128),
    "beige": (245, 245, 220), "brown": (139, 69, 19), "navy": (0, 0, 128),
}
HUE_NAMES = list(REFERENCE_RGB)[:12]
#: Category -> formality level.
FORMALITY = {
    "tank top": 0, "hoodie": 0, "t shirt": 1, "sweater": 1, "blouse": 2, "shirt": 3, "shorts": 0, "jeans": 1, "cargo trousers": 1,
    "chinos": 2, "pleated skirt": 2, "trousers": 3, "denim jacket": 1, "parka": 1, "cardigan": 2, "trench coat": 3, "blazer": 4,
    "shirt dress": 2, "slip dress": 3, "wrap dress": 3, "romper": 1, "running shoes": 0, "sneakers": 1, "sandals": 1,
    "ankle boots": 2, "loafers": 3, "heeled pumps": 4, "baseball cap": 0, "beanie": 1, "wide brim hat": 2, "wool scarf": 1,
    "silk scarf": 3, "backpack": 1, "crossbody bag": 2, "tote bag": 2, "woven belt": 1, "leather belt": 3, "sheer tights": 3,
    "leather gloves": 3, "sunglasses": 2, "hoop earrings": 2, "pendant necklace": 2, "signet ring": 2, "stacked bangles": 2,
}
WARMTH = {"chiffon": -0.5, "cotton": 0.0, "other": 0.0, "leather": 0.3, "denim": 0.4, "knitted": 0.8, "furry": 1.0}
SLEEVE_EXPOSURE = {"long": -0.4, "medium": 0.2, "not_long": 0.4, "short": 0.6, "sleeveless": 1.0}
LENGTH_EXPOSURE = {"long": -0.4, "three_quarter": 0.1, "medium_short": 0.6, "three_point": 1.0}
PENALTY = {
    "hue_clash": 25.0, "too_many_colors": 20.0, "low_contrast": 15.0, "monochrome_flat": 12.0, "pattern_clash": 18.0,
    "formality_per_level": 22.0, "season_mismatch": 30.0, "fabric_mismatch": 15.0, "dominant_area": 20.0,
    "upper_lower_ratio": 20.0, "missing_footwear": 25.0, "accessory_overload": 18.0,
}
ACHROMATIC, ANALOGOUS, TOLERANCE, SEPARATION, MAX_FAMILIES = 5.0, 30.0, 20.0, 30.0, 3
MIN_LIGHTNESS, MONO_LIGHTNESS, MAX_PATTERNS, MAX_FORMALITY, MAJOR_FORMALITY = 15.0, 8.0, 1, 2, 4
HEAVY, SUMMER, WARMTH_SPREAD, MAX_ACCESSORIES, MAX_AREA, MAX_RATIO, MIN_MEASURED = 0.7, 0.6, 1.2, 3, 0.6, 3.0, 3
UNSCORABLE = 50.0
#: Slot -> classes of the parsing mask.
MASK_CLASSES = {
    "upper": [1], "outer": [2], "lower": [3, 5, 6], "dress": [4], "romper": [21], "footwear": [11], "headwear": [7], "neckwear": [9, 23],
    "eyewear": [8], "bag": [12], "belt": [10], "socks": [18], "gloves": [19], "jewelry": [16, 17, 20, 22],
}
#: Slot -> category of a garment that only a mask shows; other slots are their own category.
MASK_CATEGORY = {"upper": "top", "outer": "outerwear", "lower": "bottom", "other": "unknown"}
#: Slots in the order in which one takes an image's only colour.
COLOR_PRIORITY = [
    "dress", "romper", "outer", "lower", "upper", "footwear", "bag", "headwear", "neckwear", "socks", "belt", "gloves", "eyewear", "jewelry", "other",
]
#: Head -> field and the slots that may take it, the first present one does.
HEADS = {
    "upper_fabric": ("fabric", ["upper"]), "lower_fabric": ("fabric", ["lower"]), "outer_fabric": ("fabric", ["outer"]),
    "upper_pattern": ("pattern", ["upper"]), "lower_pattern": ("pattern", ["lower"]), "outer_pattern": ("pattern", ["outer"]),
    "sleeve_length": ("sleeve_length", ["upper", "outer"]), "lower_length": ("length", ["lower"]), "neckline": ("neckline", ["upper", "outer"]),
}
PALETTE = {"seed": 20260101, "n_clusters": 3, "n_init": 3, "min_area_fraction": 0.02, "max_fit_pixels": 20000}
