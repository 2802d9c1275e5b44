"""The letters and marks that results must agree on. Order matters where a table is applied in turn."""

# --- fixed values: Latin transliteration to the ASCII scheme, in order of application.
# A leading "^" stands for "not after a letter, digit or colon", a trailing "+" for "before a, o or u".
LATIN_TO_ASCII = (
    ("ā", "a:"), ("ē", "e:"), ("ī", "i:"), ("ō", "o:"), ("ū", "u:"), ("ȫ", "O:"), ("ǖ", "U:"), ("ö", "O"), ("ü", "U"), ("γ", "G"),
    ("či", "ci"), ("č", "C"), ("š", "S"), ("ǰi", "\x03i"), ("^ǰ+", "J"), ("ǰ", "j"), ("k+", "\x02"), ("k", "\x01"), ("x", "\x01"),
)

# --- fixed values: two-letter sequences of the ASCII scheme, then single ones, before the letters are looked up.
ASCII_PAIRS = (
    ("ch", "C"), ("zh", "j"), ("ng", "N"), ("jy", "ᡚ"), ("ny", "ᡛ"), ("lh", "ᡀ"), ("gh", "ᡘ"), ("kh", "K"), ("ts", "ᠼ"), ("dz", "ᡜ"),
    ("x", "h"), ("G", "g"), ("q", "g"), ("=", ""), ("+", ""),
)

# --- fixed values: ASCII letters and the Todo letters they stand for, pairwise.
ASCII_LETTERS = "aeiouOU:Nnbph\x01\x02\x03gmlsStdcCjJzywkKHrvfQZ"
TODO_LETTERS = "ᠠᡄᡅᡆᡇᡈᡉᡃᡊᠨᡋᡌᡍᡍᡗᠴᡎᡏᠯᠰᠱᡐᡑᡔᡒᡓᡚᠴᡕᡖᡍᡗᡙᠷᡖᠸᠼᡜ"
ASCII_MARKS = ".,/&'\"`_*-!?<>"
TODO_MARKS = "︒︐︑︑\u180b\u180c\u180d\u180e\u200d\u202f︕︖︽︾"

# --- fixed values: Todo letters to ASCII; several letters first, then one for one.
TODO_TO_ASCII_LONG = (("ᡊ", "ng"), ("ᡜ", "dz"), ("ᠼ", "ts"), ("ᡛ", "ny"), ("ᡘ", "kh"), ("ᡀ", "lh"))
TODO_TO_ASCII_FROM = "ᡃᠠᡄᡅᡆᡇᡈᡉᠨᡋᡌᡏᠯᠰᠱᡐᡑᡔᡒᡓᠴᡕᡖᠷᠸᡗᡙᡚ\u180b\u180c\u180d\u180e\u200d\u202f︒︐︑︕︖︽︾"
TODO_TO_ASCII_TO = ":aeiouOUnbpmlsStdcCjzywrfkhj'\"`_*-.,&!?<>"
# --- fixed values: letters whose reading depends on the vowel that follows: front, back, none.
TODO_BY_VOWEL = (("ᡍ", "k", "x", "h"), ("ᡎ", "g", "G", "q"))
TODO_FRONT, TODO_BACK = "ᡄᡅᡈᡉ", "ᠠᡆᡇ"

# --- fixed values: the ASCII scheme back to the transliteration, in order of application.
ASCII_TO_LATIN = (
    ("ci", "či"), ("O:", "ȫ"), ("U:", "ǖ"), ("a:", "ā"), ("e:", "ē"), ("i:", "ī"), ("o:", "ō"), ("u:", "ū"), ("O", "ö"), ("U", "ü"),
    ("G", "γ"), ("C", "č"), ("S", "š"), ("j", "ǰ"),
)

# --- fixed values: vowels that settle the harmony of a line.
HARMONY_BACK, HARMONY_FRONT = "aāoōuū", "eēiīöȫüǖ"

# --- fixed values: Todo vowels, long mark, and the consonants of the block.
TODO_VOWELS, TODO_LONG = "ᠠᡄᡅᡆᡇᡈᡉ", "ᡃ"
TODO_BLOCK = (0x1820, 0x18AA)
TODO_CONSONANTS = "".join(chr(c) for c in range(TODO_BLOCK[0], TODO_BLOCK[1] + 1) if chr(c) not in TODO_VOWELS + TODO_LONG)

# --- fixed values: punctuation of the vertical script.
BIRGA, COMMA, FULL_STOP, FOUR_DOTS = "᠀", "᠂", "᠃", "᠅"
SOURCE_COMMA, SOURCE_STOP = "︐", "︒"
MARKS = "︐︑︒︕︖︽︾︱᠀᠁᠂᠃᠄᠅᠈᠉;()[]«»“”„…"
VERTICAL_DASH = "︱"
DASHES = "‒-―−"

# --- fixed values: Cyrillic letters of the alphabet beyond the Russian ones.
SPECIAL = "әөүһҗң"
CYRILLIC = "а-яёА-ЯЁәөүһҗңӘӨҮҺҖҢ"
LATIN = "a-zA-Zāēīōūȫǖöüγčšǰ"

# --- fixed values: letters of other keyboards and the letters they are taken for, pairwise.
LOOKALIKE_FROM = "hHҳҲғҒəƏǝӓӒäÄӧӦöÖɵƟѳѲӱӰüÜұҰYҷҶӂӁӝӜҥҤӈӇӊӉŋŊ"
LOOKALIKE_TO = "һҺһҺһҺәӘәәӘәӘөӨөӨөӨөӨүҮүҮүҮҮҗҖҗҖҗҖңҢңҢңҢңҢ"
TWINS_FROM = "aeopcxykmtbAEOPCXKMTB"
TWINS_TO = "аеорсхукмтвАЕОРСХКМТВ"

# --- fixed values: what each special letter is typed as, and the cost.
SUBSTITUTIONS = {
    "ә": {"я": 0.3, "а": 0.5, "э": 0.8, "е": 1.0},
    "ө": {"о": 0.3, "ё": 0.5, "е": 2.0, "э": 2.0},
    "ү": {"у": 0.3, "ю": 0.5},
    "һ": {"г": 0.5, "х": 1.0, "": 2.5},
    "җ": {"ж": 0.3, "дж": 1.0},
    "ң": {"н": 0.3, "нг": 1.0},
}
HABIT_DISCOUNT, COST_WEIGHT, SPLIT_PENALTY = 0.3, 2.0, 1.0
SUFFIX_MAX, STEM_MIN, STEM_MIN_FREQ, SUFFIX_MIN_COUNT = 5, 3, 3, 30

# --- fixed values: skeleton classes.
SKELETON_FROM, SKELETON_TO = "җңәяаэеөёоүюуһгх", "жнaaaaaaaauuuggg"

# --- fixed values: Russian letters in the transliteration.
RUSSIAN_FROM, RUSSIAN_TO = "абвгдзиклмнопрстуфхчшщыэжй", "abvgdziklmnoprstufxčššieǰy"
RUSSIAN_FUNCTION_WORDS = (
    "и в на что с по как это для от к о из у за до но же бы ли то так его она он они мы вы ты я был была было были есть уже ещё еще или если "
    "чтобы когда только при над под без через все всё этот эта эти тот те мне меня вас их ему ей им который которая которые"
).split()

#: The same machinery over Latin text: what a letter with a sign is typed as.
LATIN_SUBSTITUTIONS = {
    "é": ("e",), "è": ("e",), "ê": ("e",), "ä": ("a", "ae"), "ö": ("o", "oe"), "ü": ("u", "ue"), "ß": ("ss",), "ñ": ("n",), "ç": ("c",), "ó": ("o",), "í": ("i",),
}
LATIN_SKELETON_FROM, LATIN_SKELETON_TO = "éèêäöüñçóí", "eeeaouncoi"
