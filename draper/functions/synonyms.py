"""Synonyms of vocabulary values, by attribute. Parsed records depend on them."""

SYNONYMS = {
    "slot": {
        "t shirt": "upper", "tshirt": "upper", "tee": "upper", "shirt": "upper", "blouse": "upper", "top": "upper", "sweater": "upper",
        "sweatshirt": "upper", "hoodie": "upper", "tank top": "upper", "polo": "upper", "jacket": "outer", "coat": "outer",
        "blazer": "outer", "cardigan": "outer", "parka": "outer", "outerwear": "outer", "jeans": "lower", "trousers": "lower",
        "pants": "lower", "shorts": "lower", "skirt": "lower", "leggings": "lower", "chinos": "lower", "joggers": "lower",
        "sweatpants": "lower", "bottom": "lower", "bottoms": "lower", "gown": "dress", "frock": "dress", "jumpsuit": "romper",
        "playsuit": "romper", "overalls": "romper", "dungarees": "romper", "shoes": "footwear", "sneakers": "footwear",
        "trainers": "footwear", "boots": "footwear", "sandals": "footwear", "heels": "footwear", "loafers": "footwear", "flats": "footwear",
        "hat": "headwear", "cap": "headwear", "beanie": "headwear", "headband": "headwear", "scarf": "neckwear", "tie": "neckwear",
        "necktie": "neckwear", "bowtie": "neckwear", "bandana": "neckwear", "glasses": "eyewear", "eyeglasses": "eyewear",
        "sunglasses": "eyewear", "spectacles": "eyewear", "handbag": "bag", "purse": "bag", "backpack": "bag", "tote": "bag",
        "clutch": "bag", "satchel": "bag", "stockings": "socks", "tights": "socks", "hosiery": "socks", "mittens": "gloves",
        "jewellery": "jewelry", "necklace": "jewelry", "ring": "jewelry", "bracelet": "jewelry", "earrings": "jewelry", "watch": "jewelry",
    },
    "color": {
        "navy blue": "navy", "dark blue": "navy", "midnight blue": "navy", "light blue": "azure", "sky blue": "azure", "grey": "gray",
        "charcoal": "gray", "silver": "gray", "gold": "yellow", "mustard": "yellow", "tan": "beige", "cream": "beige", "khaki": "beige",
        "camel": "beige", "ivory": "white", "off white": "white", "olive": "green", "teal": "cyan", "turquoise": "cyan", "purple": "violet",
        "lavender": "violet", "pink": "rose", "maroon": "red", "burgundy": "red", "crimson": "red", "lime": "chartreuse",
        "mint": "spring green", "multicolor": "unknown", "multicoloured": "unknown", "multicolored": "unknown",
    },
    "pattern": {
        "plain": "pure color", "solid": "pure color", "solid color": "pure color", "single color": "pure color",
        "pure colour": "pure color", "none": "pure color", "print": "graphic", "printed": "graphic", "logo": "graphic", "text": "graphic",
        "stripe": "striped", "stripes": "striped", "pinstriped": "striped", "check": "lattice", "checked": "lattice",
        "checkered": "lattice", "plaid": "lattice", "gingham": "lattice", "tartan": "lattice", "grid": "lattice", "flower": "floral",
        "flowers": "floral", "flowered": "floral", "colour block": "color block", "color blocked": "color block", "patterned": "other",
    },
    "fabric": {
        "knit": "knitted", "wool": "knitted", "woolen": "knitted", "fleece": "knitted", "fur": "furry", "faux fur": "furry",
        "fake fur": "furry", "silk": "chiffon", "satin": "chiffon", "lace": "chiffon", "linen": "cotton", "jersey": "cotton",
        "canvas": "cotton", "suede": "leather", "polyester": "other", "nylon": "other",
    },
    "sleeve_length": {
        "no sleeves": "sleeveless", "strapless": "sleeveless", "spaghetti straps": "sleeveless", "short sleeve": "short",
        "short sleeves": "short", "half sleeve": "medium", "half sleeves": "medium", "three quarter sleeve": "medium",
        "three quarter sleeves": "medium", "long sleeve": "long", "long sleeves": "long", "full sleeve": "long", "full sleeves": "long",
    },
    "length": {
        "mini": "three point", "above the knee": "three point", "knee length": "medium short", "cropped": "medium short",
        "midi": "three quarter", "maxi": "long", "ankle length": "long", "full length": "long", "floor length": "long",
    },
    "neckline": {
        "v neck": "v shape", "vneck": "v shape", "v necked": "v shape", "round neck": "round", "crew neck": "round", "crewneck": "round",
        "scoop neck": "round", "square neck": "square", "turtleneck": "standing", "turtle neck": "standing", "high neck": "standing",
        "mock neck": "standing", "collar": "lapel", "collared": "lapel", "notch lapel": "lapel", "halter": "suspenders",
        "strap": "suspenders", "straps": "suspenders",
    },
}
