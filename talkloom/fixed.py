"""Fixed values that results depend on: word lists, prompt forms and thresholds, each in its natural order."""

from __future__ import annotations

#: Words that name a context, by context.
CONTEXT_WORDS = (
    ("writers_room", ("scene", "script", "screenplay", "dialogue", "character", "act", "beat", "story", "write", "draft", "revision", "neelima", "arjun")),
    ("kitchen", ("cook", "recipe", "ingredient", "kitchen", "food", "bake", "fry", "boil", "chop", "dice", "mix", "temperature", "timer", "oven", "stove")),
    ("storyboard", ("storyboard", "visual", "shot", "frame", "camera", "angle", "lighting", "composition", "generate", "image", "video", "visualize", "render")),
)

PROFANITY = ("fuck", "douche", "shit")

#: Choices that a request for an outline or plan should settle.
KNOBS = ("genre", "tone", "audience", "rating", "language", "languages", "runtime", "budget", "time", "place", "hero")

#: Marks of an answer that is still a form to fill in.
FORMS = ("...", "First, guard the core beat; then...", "Arjun: ...", "Summary: ...", "Take: ...", "Definition: ...", "Examples:")

#: Words that a transliterator leaves as they are.
SKIPPED = ("http", "https", "www")
COMMON = (
    "a", "about", "after", "again", "all", "also", "am", "an", "and", "any", "are", "as", "at", "awesome", "back", "bad", "be", "because", "before", "better", "big", "boss", "but", "by",
    "call", "can", "cant", "check", "come", "cool", "correct", "day", "did", "didnt", "do", "dont", "even", "ever", "everyone", "example", "fade", "fine", "first", "for", "from", "get", "go",
    "good", "got", "great", "had", "has", "have", "hero", "house", "hello", "hey", "hi", "how", "if", "important", "in", "into", "is", "issue", "it", "just", "keep", "know", "later", "leave",
    "left", "let", "like", "little", "look", "location", "love", "life", "maybe", "meet", "meeting", "montage", "mind", "money", "more", "most", "move", "much", "need", "never", "new", "next",
    "night", "no", "not", "now", "ok", "okay", "opening", "on", "one", "only", "camera", "open", "plan", "please", "project", "ready", "really", "right", "same", "scene", "say", "script",
    "schedule", "second", "see", "share", "since", "slow", "soon", "sorry", "sure", "take", "talk", "team", "thank", "thanks", "that", "the", "then", "there", "these", "they", "thing", "think",
    "this", "those", "time", "today", "tomorrow", "tonight", "too", "try", "update", "world", "risk", "risks", "responsibility", "someone", "something", "everything", "nothing", "society",
    "situations", "free", "very", "wait", "want", "was", "we", "well", "were", "what", "when", "where", "which", "who", "why", "will", "voice", "work", "wow", "yeah", "yes", "yo", "you", "your",
)

#: What a question on a decision ends with, by domain; any other domain takes the last.
DECISION_ENDS = ((("film", "production"), " What should we do?"), (("kitchen",), " How do I handle this?"), ((), " Your take?"))

#: (question, answer, domain, task) of each generator; names in braces are fields of the row.
PROMPTS = {
    "scene": (
        ("Summarize the scene briefly, then suggest 3 punch-up options for dialogue (keep Telugu+English vibe, keep character intent). Scene:\n\n{text}", "Summary: ...\nPunch-ups:\n1) ...\n2) ...\n3) ...", "film", "scene_punchup"),
        ("Continue this scene with one natural beat (4–8 lines), keeping tone and language mix. Avoid cliches; end on a small reveal or comic turn. Scene:\n\n{text}", "Arjun: ...\nSwarna: ...\n[beat]\nArjun (aside): ...", "film", "scene_continue"),
    ),
    "word": (
        ("Define '{word}' crisply and give 2 witty examples (one Telugu-flavored).", "Definition: {definition}\nExamples:\n1) ...\n2) ...", "language", "define_witty"),
        ("Use '{word}' in a one-line character beat suitable for a rom-com scene.", "She shoots him a look, the veneer cracking just enough to show the hurt underneath.", "film", "use_in_scene"),
    ),
    "principle": (
        ("Explain this principle in your voice and give a grounded example: {principle}", "Take: ...\nExample: ...", "persona", "principle_explain"),
        ("Given the principle '{principle}', how would you advise a junior AD facing a tough call on set?", "First, guard the core beat; then...", "production", "principle_to_decision"),
    ),
    "decision": (
        ("Scenario: {situation}\nPick and justify your choice briefly.", "Choice: {choice}\nWhy: {rationale}", "{domain}", "decision_playback"),
        ("Scenario (same): {situation}\nList the heuristics and risks you weighed.", "Heuristics: {heuristics}\nRisks: ...", "{domain}", "decision_heuristics"),
    ),
}

#: Gates of a dataset: (check, low, high, what a miss means).
DATASET_GATES = (
    ("total", 750, 1050, "fail"), ("duplicates", None, 0, "warn"),
    ("domain film", 0.35, 0.45, "warn"), ("domain persona", 0.25, 0.35, "warn"), ("domain tools", 0.15, 0.25, "warn"), ("domain general", 0.05, 0.15, "warn"),
    ("lang te", 0.35, 0.50, "info"), ("lang en", 0.30, 0.40, "info"), ("lang mixed", 0.15, 0.25, "info"),
    ("invalid", None, 0, "fail"), ("p95 tokens", None, 2048, "warn"), ("tool examples", 30, None, "warn"), ("system prompts", None, 3, "warn"), ("metadata share", 0.95, None, "warn"),
)
#: Gates of answers; a share of very short ones must lie below its bound.
ANSWER_GATES = (("avg words", 20, None, "fail"), ("very short pct", None, 10, "fail"), ("ends with ye", None, 0, "fail"), ("meta content", None, 0, "fail"), ("code-switched pct", 30, None, "warn"))

#: Topics that a dataset should cover, how often each, and the least percentage of the second language.
TOPICS = ("film", "production", "persona", "decision-making", "technical", "creative", "planning")
TOPIC_LEAST = 50
SCRIPT_LEAST = 30

#: What a request is answered from: words that make it one about scripts, tags of the style card, tags of the snippet for each
#: keyword, and (words, query, number) of memories, the first that fits.
SCRIPT_WORDS = ("script", "outline", "beat", "scene", "logline", "pitch", "character", "genre")
STYLE_TAGS = ("script", "style")
SNIPPET_ROUTES = (
    ("logline", ("script", "template", "logline")), ("pitch", ("script", "template", "pitch")), ("scene", ("script", "template", "scene")), ("outline", ("script", "template", "structure")),
    ("beat", ("script", "template", "structure")), ("character", ("script", "template", "character")), ("checklist", ("script", "template", "scene")),
    ("thriller", ("script", "template", "genre", "thriller")), ("rom-com", ("script", "template", "genre", "rom-com")), ("family", ("script", "template", "genre", "family")),
)
MEMORY_ROUTES = ((("drifts", "standing note"), "screenplay drift", 2), (("budget", "helicopter"), "budget", 2), (("outline", "beat"), "beats", 1))
