"""Sentences of issues and roasts. Texts depend on them."""

MESSAGES = {
    "hue_clash": "The {a} and the {b} sit {delta} degrees apart in hue.",
    "too_many_colors": "This outfit uses {families} separate hue families, above the limit of {limit}.",
    "low_contrast": "The {a} and the {b} differ by {spread} points of lightness.",
    "monochrome_flat": "The outfit stays on one hue family with a lightness spread of {spread} points.",
    "pattern_clash": "This outfit has {count} patterned garments, above the limit of {limit}.",
    "formality_mismatch": "The {a} and the {b} sit {gap} formality levels apart.",
    "season_mismatch": "The {a} uses a heavy fabric while the {b} has an exposed cut.",
    "fabric_mismatch": "The {a} and the {b} use fabrics at opposite ends of the warmth range.",
    "dominant_area": "The {a} covers {share} percent of the frame.",
    "upper_lower_ratio": "The {a} covers {ratio} times the area of the {b}.",
    "missing_footwear": "No footwear is described for this outfit.",
    "accessory_overload": "This outfit has {count} accessories, above the limit of {limit}.",
    "other": "This description carries no usable colour, category or area evidence.",
}
LEADS = {
    "hue_clash": {
        "gentle": "The colour conversation between {subject} never really settles.",
        "playful": "{Subject} are arguing across the colour wheel.",
        "savage": "{Subject} look like they were assigned by random colour picker.",
    },
    "too_many_colors": {
        "gentle": "There are more colour ideas here than the outfit can comfortably carry.",
        "playful": "This palette brought every opinion to the meeting.",
        "savage": "You did not get dressed; you got sorted into every colour idea at once.",
    },
    "low_contrast": {
        "gentle": "{Subject} sit so close in value that the outfit blurs into itself.",
        "playful": "{Subject} are dressed on the same brightness setting.",
        "savage": "{Subject} merge into one long beige paragraph.",
    },
    "monochrome_flat": {
        "gentle": "The monochrome idea is sound, but it needs one sharper focal point.",
        "playful": "Monochrome can be chic; this one forgot to invite contrast.",
        "savage": "This outfit found one note and played it for the entire concert.",
    },
    "pattern_clash": {
        "gentle": "The patterns are competing instead of taking turns.",
        "playful": "These patterns are all speaking at once.",
        "savage": "Three patterns walked in and none of them agreed to share the stage.",
    },
    "formality_mismatch": {
        "gentle": "{Subject} land in different dress codes.",
        "playful": "Half the outfit booked dinner, the other half showed up for errands.",
        "savage": "This outfit is formal in one tab and casual in another.",
    },
    "season_mismatch": {
        "gentle": "{Subject} feel built for different weather.",
        "playful": "One piece says winter and another says the sun is out.",
        "savage": "The forecast clearly was not invited into this decision.",
    },
    "fabric_mismatch": {
        "gentle": "{Subject} pull in different texture directions.",
        "playful": "One fabric wants a dinner reservation, the other wants utility pockets.",
        "savage": "These fabrics met five minutes ago and it shows.",
    },
    "proportion_imbalance": {
        "gentle": "The silhouette could use a clearer line.",
        "playful": "The proportions are having a hard time finding the waist and hem.",
        "savage": "The silhouette starts a sentence and never finds the full stop.",
    },
    "missing_footwear": {
        "gentle": "The outfit reaches the ankle and then stops negotiating.",
        "playful": "Strong look, unfinished ending.",
        "savage": "The outfit forgot the final sentence: shoes.",
    },
    "accessory_overload": {
        "gentle": "The accessories are doing a little too much at the same time.",
        "playful": "Every accessory wanted a speaking role.",
        "savage": "This is less styling and more a traffic jam of add-ons.",
    },
    "other": {
        "gentle": "There is not enough reliable detail here to judge the outfit fairly.",
        "playful": "The outfit brief arrived, but the evidence did not.",
        "savage": "There is not enough here to be savage about with a straight face.",
    },
}
FOLLOWUPS = {
    "hue_clash": "{Subject} need one colour to lead and the rest to support.",
    "too_many_colors": "Editing the palette down would make the whole look feel intentional.",
    "low_contrast": "One lighter or darker anchor would give the eye somewhere to land.",
    "monochrome_flat": "A stronger light-dark break would wake it up.",
    "pattern_clash": "Keeping one pattern as the feature would calm the frame down.",
    "formality_mismatch": "Matching the shoes and outer layer to the same register would fix a lot.",
    "season_mismatch": "Choose one weather story and let every piece support it.",
    "fabric_mismatch": "Bringing the textures closer together would make the look feel deliberate.",
    "proportion_imbalance": "A cleaner hem relationship would help the outfit breathe.",
    "missing_footwear": "Adding the right pair of shoes would complete the sentence.",
    "accessory_overload": "Removing just one or two pieces would restore the hierarchy.",
    "other": "Re-running the upstream stages would help more than guessing.",
}
SUGGESTIONS = {
    "hue_clash": [
        "Let the {first} stay loud and move the {second} to a neutral.",
        "Repeat one accent colour once and let the rest quiet down.",
    ],
    "too_many_colors": [
        "Pick one accent and take the rest of the palette neutral.",
        "Make one accessory repeat a clothing colour so the palette looks intentional.",
    ],
    "low_contrast": [
        "Create more separation with a lighter or darker {second}.",
        "Use a shoe or belt with clearer contrast to break the block.",
    ],
    "monochrome_flat": [
        "Add one lighter or darker piece to create a focal point.",
        "Use texture or a contrasting shoe to stop the outfit reading as one block.",
    ],
    "pattern_clash": [
        "Keep the {first} as the feature and make the other patterned pieces plain.",
        "Limit the outfit to one dominant pattern.",
    ],
    "formality_mismatch": [
        "Either dress the footwear up or relax the tailoring so both speak the same language.",
        "Keep every major piece in the same formality band.",
    ],
    "season_mismatch": [
        "Choose one season and let every piece support that weight and coverage.",
        "Swap the most out-of-season piece, starting with the {first}.",
    ],
    "fabric_mismatch": [
        "Pair delicate fabrics with cleaner tailored pieces or group the utilitarian fabrics together.",
        "Starting with the {second}, move one texture closer to the rest of the outfit.",
    ],
    "proportion_imbalance": [
        "Balance the silhouette by clarifying the hem lengths and waist line.",
        "Use either a shorter outer layer or a longer bottom to restore the line.",
    ],
    "missing_footwear": [
        "Add footwear that matches the outfit's overall formality.",
    ],
    "accessory_overload": [
        "Remove one or two accessories so the clothes have room to lead.",
        "Keep one hero accessory and let the rest support it.",
    ],
    "other": [
        "Re-run perception; this description does not carry enough usable garment detail.",
    ],
}
UNSCORABLE = "There is not enough reliable detail here to roast the clothes honestly."
UNSCORABLE_SUGGESTION = "Re-run perception; this description does not carry enough usable garment detail."
COMPLIMENT = "{garments} work together cleanly. The outfit looks considered without trying too hard."
KEEP = "Keep it exactly as it is."
EMPTY_SUGGESTION = "Simplify the outfit by letting one idea lead and the rest support it."
