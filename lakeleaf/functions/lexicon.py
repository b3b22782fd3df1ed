"""Word lists, patterns and limits of the query semantics."""

# --- Fixed values: they must equal those of the semantics this engine implements. ---

INJECTION_HIGH = (
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|context)",
    r"disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?)",
    r"forget\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?)",
    r"override\s+(all\s+)?(previous|prior|above|system)\s+(instructions?|prompts?|rules?)",
    r"you\s+are\s+now\s+(a|an|the)\s+",
    r"act\s+as\s+(a|an|the|if)\s+",
    r"pretend\s+(to\s+be|you\s+are)\s+",
    r"switch\s+to\s+.{0,20}\s*mode",
    r"(show|reveal|display|print|output|repeat|echo)\s+(me\s+)?(your|the)\s+(system\s+)?(prompt|instructions?|rules?|guidelines?)",
    r"what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?|guidelines?)",
    r"(give|tell)\s+me\s+your\s+(system\s+)?(prompt|instructions?|rules?)",
    r"<\s*system\s*>",
    r"<\s*/?\s*(?:system|user|assistant|human|ai)\s*>",
    r"\[INST\]",
    r"\[/INST\]",
    r"<<\s*SYS\s*>>",
    r"BEGIN\s+SYSTEM\s+PROMPT",
    r"END\s+SYSTEM\s+PROMPT",
)
INJECTION_MEDIUM = (
    r"from\s+now\s+on",
    r"your\s+new\s+(task|role|job|purpose)\s+is",
    r"(list|show|print|display)\s+(all\s+)?(environment\s+variables?|env\s+vars?)",
    r"(list|show|print|display)\s+(all\s+)?(api\s+keys?|secrets?|credentials?)",
)
# Names of one deployment and of its code are left to the caller.
LEAKAGE = (
    r"GEMINI_API_KEY", r"QDRANT_HOST", r"QDRANT_PORT", r"AWS_ACCESS_KEY_ID", r"AWS_SECRET_ACCESS_KEY", r"GEMINI_MODEL",
    r"intfloat/multilingual-e5-large", r"system_instruction\s*=", r"api_key\s*=\s*['\"]",
)
NO_DATA_TAMIL = (
    r"தகவல்\s*(கள்\s*)?கிடைக்கவில்லை", r"தகவல்\s*(கள்\s*)?இல்லை", r"தரவுத்தளத்தில்\s*(தற்போது\s*)?இல்லை", r"பதிவு\s*செய்யப்படவில்லை",
    r"இன்னும்\s*(பதிவு|குறியீடு|நுழைவு)", r"(indexed|index)\s*செய்யப்படவில்லை", r"குறிப்பிட்ட\s*(இதழ்|தொகுதி|கட்டுரை).*இல்லை",
    r"(இந்த|குறிப்பிட்ட).*தரவு.*இல்லை", r"தற்போது\s*(இந்த|இதற்கான)?\s*தகவல்", r"கிடைக்கவில்லை", r"இடம்\s*பெற(வில்லை|ற்று\s*இல்லை)",
    r"காணப்படவில்லை", r"கண்டுபிடிக்க\s*(இயல|முடி)வில்லை", r"தொடர்பான\s*தகவல்.*இல்லை", r"உள்ளடக்கத்தில்.*இல்லை", r"சேகரிக்கப்படவில்லை",
    r"நேரடியாக\s*தொடர்பில்லை",
)
NO_DATA_ENGLISH = (
    r"not\s+(yet\s+)?(been\s+)?indexed",
    r"data\s+is\s+not\s+(currently\s+)?available",
    r"no\s+(relevant\s+)?information\s+(is\s+)?(available|found)",
    r"not\s+(currently\s+)?(available|present)\s+in\s+(the\s+)?(database|archive|collection)",
    r"has\s+not\s+(yet\s+)?been\s+(digitized|processed|extracted|added)",
    r"(this|the)\s+(specific\s+)?(issue|volume|article|data)\s+(is\s+)?not\s+(available|found|indexed)",
    r"no\s+data\s+(is\s+)?(available|found)",
    r"do(es)?\s+not\s+(currently\s+)?contain",
    r"not\s+(currently\s+)?available\s+in\s+(the\s+)?database",
    r"(could|cannot|can'?t)\s+(not\s+)?find\s+(any\s+)?(relevant|specific|direct)",
    r"no\s+(specific|direct|relevant)\s+(information|data|content|mention)",
    r"do(es)?\s+not\s+(directly\s+)?(address|answer|contain|cover|mention)",
    r"(context|documents?)\s+(provided\s+)?do(es)?\s+not\s+(directly\s+)?(relate|pertain|answer)",
    r"not\s+directly\s+related\s+to",
    r"unable\s+to\s+(find|locate|identify)",
    r"(don'?t|do\s+not)\s+have\s+(any\s+)?(information|data)\s+(about|on|regarding)",
)
STOP_WORDS = ("உள்ள", "என்ற", "என்று", "என்ன", "எந்த", "ஒரு", "இது", "அது", "இந்த", "அந்த", "மற்றும்", "பற்றி", "பற்றிய", "எனும்", "யாவை", "உள்ளது")
HONORIFICS = (
    r"மு\.,?\s*", r"டாக்டர்\.?\s*", r"திரு\.,?\s*", r"திருமதி\.?\s*", r"Dr\.?\s*", r"Mr\.?\s*", r"Mrs\.?\s*", r"கவிஞர்\.?\s*",
    r"பேராசிரியர்\.?\s*", r"அறிஞர்\.?\s*", r"புலவர்\.?\s*", r"கவியரசு\.?\s*", r"பாவேந்தர்\.?\s*",
)
VOWEL_FOLDS = (("ஆ", "அ"), ("ஈ", "இ"), ("ஊ", "உ"), ("ே", "ெ"), ("ோ", "ொ"))
POSSESSIVES = (
    ("னின்", "ன்"), ("ரின்", "ர்"), ("யின்", ""), ("வின்", ""), ("னால்", "ன்"), ("ரால்", "ர்"), ("யால்", ""),
    ("னை", "ன்"), ("ரை", "ர்"), ("யை", ""), ("வை", ""),
)
POSSESSIVES_AFTER_TAMIL = ("ஆல்", "ஐ")
ALIASES = {
    "கலைஞர்": ("கருணாநிதி", "மு.கருணாநிதி", "மு. கருணாநிதி"),
    "கருணாநிதி": ("கலைஞர்", "மு.கருணாநிதி", "மு. கருணாநிதி"),
    "அண்ணா": ("அண்ணாதுரை", "சி.என்.அண்ணாதுரை"),
    "அண்ணாதுரை": ("அண்ணா", "சி.என்.அண்ணாதுரை"),
    "பாரதிதாசன்": ("பாவேந்தர்", "பாவேந்தர் பாரதிதாசன்"),
    "பாவேந்தர்": ("பாரதிதாசன்", "பாவேந்தர் பாரதிதாசன்"),
    "கண்ணதாசன்": ("கவியரசு", "கவியரசு கண்ணதாசன்"),
    "கவியரசு": ("கண்ணதாசன்", "கவியரசு கண்ணதாசன்"),
}
TAXONOMY = {
    "FICTION": ("புனைவு", "Fiction/Serial"),
    "EDITORIAL": ("தலையங்கம்", "Editorial/Opinion"),
    "LITERARY_REVIEW": ("இலக்கிய விமர்சனம்", "Literary Review"),
    "POETRY": ("கவிதை", "Poetry"),
    "QA_COLUMN": ("கேள்வி பதில்", "Q&A Column"),
    "ARTS_CULTURE": ("கலை கலாச்சாரம்", "Arts & Culture"),
    "SATIRE_HUMOR": ("நகைச்சுவை", "Satire/Humor"),
    "CLASSICAL_LIT": ("செந்தமிழ் இலக்கியம்", "Classical Literature"),
    "PUBLIC_FORUM": ("பொது மேடை", "Public Forum"),
    "WOMENS_ISSUES": ("பெண்கள் நலன்", "Women's Issues"),
    "RELIGIOUS_DEBATE": ("மத விவாதம்", "Religious Debate"),
    "CHILDRENS": ("சிறுவர் பகுதி", "Children's Section"),
    "POLITICAL": ("அரசியல்", "Political Commentary"),
    "BIOGRAPHY": ("வரலாறு", "Biography/History"),
    "GENERAL": ("பொது", "General/Uncategorized"),
}
#: Category: (exact titles, parts of titles).
TITLE_RULES = {
    "FICTION": (("சரசா", "அவா", "பொட்டை", "துரோகி", "வேண்டாத ஆசை", "மண்ணின் குரல்", "காதல் கடிதம்", "அன்பின் அழுகை", "நிழல்", "தீ", "புயல்", "புதிய வழி"), ("கதை", "நாவல்", "சிறுகதை", "தொடர்கதை", "நீள்கதை")),
    "EDITORIAL": (("காலமும் கருத்தும்", "எங்கள் எண்ணம்", "ஆசிரியர் குறிப்பு"), ("தலையங்கம்", "ஆசிரியர்")),
    "LITERARY_REVIEW": (("வளரும் இலக்கியம்",), ("இலக்கிய விமர்சனம்", "புத்தக விமர்சனம்", "நூல் விமர்சனம்", "இலக்கியம்")),
    "POETRY": (("பாரதிதாசன் பரம்பரை",), ("கவிதை", "பாட்டு", "பாடல்", "கவிஞர்")),
    "QA_COLUMN": (("கண் திறக்குமா?", "உங்களுக்குத் தெரியுமா?"), ("கேள்வி பதில்", "வினா விடை")),
    "ARTS_CULTURE": (("கலையுலகம்",), ("கலை", "சினிமா", "நாடகம்", "இசை", "நடனம்")),
    "SATIRE_HUMOR": (("வம்பு மடம்", "ஆடும் மாடும்"), ("நகைச்சுவை", "வம்பு", "சிரிப்பு", "கேலி")),
    "CLASSICAL_LIT": (("சிலப்பதிகாரக் காட்சிகள்",), ("சிலப்பதிகாரம்", "திருக்குறள்", "சங்க இலக்கியம்", "தொல்காப்பியம்", "செந்தமிழ்")),
    "PUBLIC_FORUM": (("பொது மேடை", "நமக்குள்ளே"), ("மேடை", "கடிதம்", "வாசகர்")),
    "WOMENS_ISSUES": (("பெண்கள் முன்னேற்றம்", "மகளிர் அழகுக் குறிப்புகள்"), ("பெண்கள்", "மகளிர்", "பெண்")),
    "RELIGIOUS_DEBATE": (("மதம் அவசியமா?",), ("மதம்", "சமயம்", "கடவுள்")),
    "CHILDRENS": (("சிறுவர் அரங்கம்",), ("சிறுவர்", "குழந்தை")),
    "POLITICAL": ((), ("அரசியல்", "தேர்தல்", "காங்கிரஸ்", "சுதந்திரம்", "ஆட்சி", "திராவிட")),
    "BIOGRAPHY": ((), ("வரலாறு", "சரித்திரம்", "வாழ்க்கை வரலாறு", "நினைவு", "சுயசரிதை")),
}
SERIAL_TITLES = ("சரசா", "அவா", "பொட்டை", "துரோகி", "வேண்டாத ஆசை", "மண்ணின் குரல்", "காதல் கடிதம்")
CATEGORY_KEYWORDS = {
    "FICTION": "கதை நாவல் சிறுகதை தொடர்கதை கதாபாத்திரம் காதல் வாழ்க்கை சரசா அவா பொட்டை துரோகி",
    "EDITORIAL": "தலையங்கம் ஆசிரியர் கருத்து எண்ணம் காலம் சமூகம் நாடு முன்னேற்றம்",
    "LITERARY_REVIEW": "இலக்கியம் விமர்சனம் புத்தகம் நூல் படைப்பு எழுத்தாளர் இலக்கிய",
    "POETRY": "கவிதை பாட்டு பாடல் கவிஞர் பாரதிதாசன் வெண்பா செய்யுள்",
    "QA_COLUMN": "கேள்வி பதில் தெரியுமா விடை வினா",
    "ARTS_CULTURE": "கலை சினிமா நாடகம் இசை நடனம் ஓவியம் கலையுலகம்",
    "SATIRE_HUMOR": "நகைச்சுவை வம்பு சிரிப்பு கேலி நையாண்டி",
    "CLASSICAL_LIT": "சிலப்பதிகாரம் திருக்குறள் சங்க தொல்காப்பியம் செந்தமிழ் பழந்தமிழ்",
    "PUBLIC_FORUM": "மேடை கடிதம் வாசகர் பொது கருத்து",
    "WOMENS_ISSUES": "பெண்கள் மகளிர் பெண் அழகு முன்னேற்றம் சமூக நிலை",
    "RELIGIOUS_DEBATE": "மதம் சமயம் கடவுள் ஆன்மீகம் நம்பிக்கை",
    "CHILDRENS": "சிறுவர் குழந்தை பிள்ளை விளையாட்டு",
    "POLITICAL": "அரசியல் தேர்தல் காங்கிரஸ் சுதந்திரம் ஆட்சி திராவிட இயக்கம் கட்சி",
    "BIOGRAPHY": "வரலாறு சரித்திரம் வாழ்க்கை நினைவு சுயசரிதை புகழ்",
    "GENERAL": "இதழ் கட்டுரை பகுதி பொது",
}

# --- Limits. ---

CHUNK_SIZE = 500
MAX_QUERY = 500
DENSE_THRESHOLD = 0.65
TFIDF_THRESHOLD = 0.15
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
