"""The lexicons, phrases and weights that results depend on."""

DIRECTIONS = ["north", "south", "east", "west", "northwest", "northeast", "southwest", "southeast", "northern", "southern", "eastern", "western", "northeastern", "northwestern", "southeastern", "southwestern", "left", "right", "forward", "ahead", "straight", "backwards", "backward", "reverse"]
DIRECTION_GROUPS = {
    "forward": ["forward", "ahead", "straight", "front"],
    "backward": ["backward", "backwards", "reverse", "back", "behind"],
    "left": ["left", "port"],
    "right": ["right", "starboard"],
    "north": ["north", "northern", "northward"],
    "south": ["south", "southern", "southward"],
    "east": ["east", "eastern", "eastward"],
    "west": ["west", "western", "westward"],
    "northeast": ["northeast", "northeastern", "north-east"],
    "northwest": ["northwest", "northwestern", "north-west"],
    "southeast": ["southeast", "southeastern", "south-east"],
    "southwest": ["southwest", "southwestern", "south-west"],
}
LANDMARKS = ["building", "structure", "road", "street", "highway", "house", "parking", "lot", "area", "destination", "target", "goal", "construction", "edifice"]
LANDMARK_GROUPS = {
    "building": ["building", "structure", "house", "edifice", "construction"],
    "road": ["road", "street", "highway", "path"],
    "destination": ["destination", "target", "goal", "endpoint"],
}
COLORS = ["gray", "grey", "brown", "red", "blue", "green", "white", "black", "sand", "yellow", "orange", "pink", "purple", "beige"]
COLOR_GROUPS = {"gray": ["gray", "grey"], "grey": ["grey", "gray"]}
SHAPES = ["square", "rectangular", "rectangle", "c-shaped", "c shape", "circle", "round", "triangular", "hexagonal", "octagonal", "l-shaped", "u-shaped", "cylindrical", "dome", "arch", "irregular"]
SHAPE_GROUPS = {
    "rectangular": ["rectangular", "rectangle"],
    "rectangle": ["rectangle", "rectangular"],
    "square": ["square"],
    "round": ["round", "circle"],
    "circle": ["circle", "round"],
    "c-shaped": ["c-shaped", "c shape"],
    "c shape": ["c shape", "c-shaped"],
    "l-shaped": ["l-shaped", "l shape"],
    "u-shaped": ["u-shaped", "u shape"],
}
MOVEMENTS = ["move", "go", "turn", "head", "fly", "navigate", "reverse", "pivot", "proceed", "advance"]
MOVEMENT_GROUPS = {
    "move": ["move", "go", "head", "proceed", "travel", "navigate", "advance"],
    "turn": ["turn", "rotate", "pivot", "swing", "veer"],
    "reverse": ["reverse", "back", "backwards", "backward"],
    "fly": ["fly", "soar", "hover", "pilot"],
}
RELATIONS = ["next to", "beside", "near", "in front of", "across", "over", "through", "around"]
CLOCK_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]

#: category: terms, synonym groups. The validator's lexicon has relations in place of colors and shapes.
EVAL = {"directions": (DIRECTIONS, DIRECTION_GROUPS), "landmarks": (LANDMARKS, LANDMARK_GROUPS), "colors": (COLORS, COLOR_GROUPS), "shapes": (SHAPES, SHAPE_GROUPS), "movement_verbs": (MOVEMENTS, MOVEMENT_GROUPS)}
VALIDATOR = {"directions": (DIRECTIONS, DIRECTION_GROUPS), "landmarks": (LANDMARKS, LANDMARK_GROUPS), "movement_verbs": (MOVEMENTS, MOVEMENT_GROUPS), "spatial_relations": (RELATIONS, {})}

YES = ["yes", "yeah", "yep", "affirmative", "in your field of view", "in your field of vision", "you can see it", "you can see the destination", "visible", "in sight"]
NO = ["no", "nope", "negative", "not in your field of view", "not in your field of vision", "cannot see", "can't see", "not visible", "out of sight"]
BANNED = ["Yes, fate is in your field of vision", "Yes, your destination is in your field of view", "You can see it"]
WEIGHTS = {"direction": 1.0, "attribute": 0.8, "landmark": 0.6, "movement": 0.6, "yesno": 0.4, "form": 0.2}

POSITIVES = {"NORTH": ("head north", "go northward"), "SOUTH": ("head south", "go southward"), "EAST": ("head east", "go eastward"), "WEST": ("head west", "go westward"), "LEFT": ("turn left", "go left"), "RIGHT": ("turn right", "go right"), "FORWARD": ("go forward", "move ahead"), "BACKWARD": ("go backward", "move back")}
OPPOSITES = {"NORTH": "south", "SOUTH": "north", "EAST": "west", "WEST": "east", "LEFT": "right", "RIGHT": "left", "FORWARD": "backward", "BACKWARD": "forward"}
SUBSTITUTIONS = {"move towards": "head toward", "turn to": "rotate to", "destination": "target", "building": "structure", "you will see": "you'll observe", "go to": "proceed to", "looks like": "appears to be"}
HINTS = {
    "spatial": "HINT: Use clock directions (1-12 o'clock) and landmark descriptions.",
    "movement": "HINT: Provide clear movement instructions (turn left/right, go straight).",
    "landmark": "HINT: Describe visible landmarks, buildings, and structures.",
    "navigation": "HINT: Give precise navigation with distance and direction.",
}
ATTRIBUTE_CUES = ["color", "colour", "shape", "look like", "appearance", "c shaped", "c-shaped", "rectangular", "rectangle", "square", "round", "circle", "basketball court", "roof"]
QUESTION_CUES = [
    r"\b(what|which)\s+(does|do|is)\s+(the\s+)?destination.*(look|colour|color|shape)",
    r"\b(color|colour|shape|look like|appearance|c\s*-?shaped|rectangular|rectangle|square|round|circle|basketball court|roof)\b",
]
#: name: pattern, of frequent instruction patterns.
PATTERNS = {
    "X o'clock": r"(\d+)\s*o'?clock", "X:Y time format": r"(\d+):(\d+)", "turn to your X o'clock": r"turn\s+to\s+your\s+(\d+)\s*o'?clock", "move towards your X o'clock": r"move\s+towards\s+your\s+(\d+)\s*o'?clock", "turn on X o'clock": r"turn\s+on\s+(\d+)\s*o'?clock",
    "head X": r"head\s+(\w+)", "turn X": r"turn\s+(\w+)", "move X": r"move\s+(\w+)", "go X": r"go\s+(\w+)",
    "destination is X": r"destination\s+is\s+(.+)", "your destination is X": r"your\s+destination\s+is\s+(.+)", "that's your destination": r"that'?s\s+your\s+destination",
    "you will see X": r"you\s+will\s+see\s+(.+)", "looks like X": r"looks?\s+like\s+(.+)", "it is X": r"it\s+is\s+(.+)",
    "pass X": r"pass\s+(.+)", "cross X": r"cross\s+(.+)", "over X": r"over\s+(.+)", "next to X": r"next\s+to\s+(.+)", "in front of X": r"in\s+front\s+of\s+(.+)",
    "X building": r"(\w+)\s+building", "building with X": r"building\s+with\s+(.+)", "structure X": r"structure\s+(.+)",
    "you are near/close": r"you\s+are\s+(near|close)", "very close": r"very\s+close", "nearly there": r"nearly\s+there",
}
VOCABULARY = {
    "movement_verbs": ["turn", "move", "go", "head", "fly", "proceed"],
    "direction_words": ["north", "south", "east", "west", "left", "right", "forward", "straight"],
    "landmark_types": ["building", "structure", "house", "parking", "road", "street"],
    "spatial_relations": ["next", "front", "behind", "over", "under", "near", "close"],
    "descriptors": ["large", "small", "long", "rectangular", "gray", "grey"],
}
