"""Patterns, constants and lists that results depend on."""

#: White space as Python's str methods see it (29 code points), as the inside of a class.
WS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BOILERPLATE = "(?is)START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\\n(.*?)END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
NOT_ASCII_TEXT = "[^a-zA-Z0-9'\".,!?;:()\\-\\n ]"
NOT_TEXT = "[^\\p{L}\\p{N}_" + WS + "'\".,!?;:()\\-–—‘’“”…/%&°£$]"
NOT_WORD = "[^\\p{L}\\p{N}_]+"
HYPHEN_BREAK = "-\\n+"
SENTENCE_END = "(?s)^(.*[.!?][\"']?)[" + WS + "]"
GLOSS = "^([^" + WS + "]+(?:[" + WS + "][^" + WS + "]+){0,3}?)[" + WS + "]*\\(([^()]*(?:\\([^()]*\\)[^()]*)*)\\)[" + WS + "]*"
GLOSS_INSIDE = "pronounc|IPA|[\u0250-\u02af\u02b0-\u02ff\u0300-\u036f]|:[" + WS + "]*[^)]*[\u0370-\u1fff\u3000-\u9fff\uac00-\ud7ff]"
FENCE = "^```(?:json)?[" + WS + "]*|[" + WS + "]*```$"
CONTROL = "[\\x00-\\x08\\x0b-\\x1f\\x7f]"
BREAKS = "[" + WS + "]*\\n[" + WS + "]*"
BLANKS = "[ \\t]{2,}"
YEAR = "\\b(?:1[0-9]{3}|20[0-2][0-9])\\b"
NUMBER = "\\b\\p{Nd}[\\p{Nd},]*(?:\\.\\p{Nd}+)?\\b"
EVAL_LINE = "\\[eval\\] step\\s+(\\d+)/\\d+ \\| train loss ([\\d.]+) .*? \\| val loss ([\\d.]+) .*?\\| best val ([\\d.]+)@\\d+ .*?\\| ([\\d,]+) tok/s"
CONSOLE_LINE = "\\[console\\] step\\s+(\\d+)/\\d+ .*?\\| ([\\d,]+) tok/s"
END_OF_TEXT = "<|endoftext|>"
SHARD_SEPARATOR = "\n\n<|endoftext|>\n\n"
NO_CONTEXT = "Context: N/A"
STOP_MARKERS = ("\n\n", "\nQuestion:", "\nContext:")
MIN_CLEAN_CHARS, MIN_ARTICLE_CHARS, PREFIX_CHARS = 150, 500, 1200
MIN_VALUES, MIN_ANSWER_WORDS, MAX_PAIRS = 3, 4, 4
MIN_COSINE, TOP_K = 0.55, 10
CATEGORY_WEIGHTS = (20, 20, 30, 20, 10)
CONTEXT = "(?s)^Context: (.*?)\\nQuestion: "
UNKNOWN_CHECKPOINT = "unknown checkpoint"
MAX_EXAMPLE_TOKENS, MAX_PASSAGE_TOKENS = 900, 400
TAIL_SHARE = 0.8
#: Words of a byte-level vocabulary, for the regex module.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAUSE = r"[.!?,;:]+(\s+)"
