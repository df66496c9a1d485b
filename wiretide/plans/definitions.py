"""The built-in checks and the catalogue of clauses that they cite."""

from __future__ import annotations

from ..operators import checks

#: Identifiers, severities and clauses. Titles and texts are this package's own.
CHECKS = {
    "modbus-unauthenticated-write": {
        "title": "Modbus/TCP requests that change values",
        "severity": "high",
        "standards": [("IEC-62443-3-3", "SR 1.1"), ("CLC/TS 50701", "undetermined-1")],
        "evaluate": checks.unauthenticated_write,
        "rationale": "Seen: a request with a function code that sets coils or registers, in a session recognised as Modbus/TCP. A frame of this protocol has eight bytes of header, and none of them names a user or proves anything.",
        "remediation": "List the stations that have to write, and drop write function codes from all other addresses where the cell meets the plant network.",
    },
    "cleartext-protocol": {
        "title": "Remote access or file transfer that can be read",
        "severity": "medium",
        "standards": [("IEC-62443-3-3", "SR 4.1"), ("CLC/TS 50701", "undetermined-2")],
        "evaluate": checks.cleartext_protocol,
        "rationale": "Seen: payload in the form of Telnet negotiation, FTP commands or HTTP requests. Each byte travels as it was typed, so a copy of the packets is a copy of the login.",
        "remediation": "Replace the service by one that encrypts (SSH, SFTP, HTTPS). Until then, keep the switch ports that can see the link to as few as possible.",
    },
    "unauthenticated-industrial-protocol": {
        "title": "Sessions of a fieldbus protocol that has no logins",
        "severity": "high",
        "standards": [("IEC-62443-3-3", "SR 1.2"), ("CLC/TS 50701", "undetermined-1")],
        "evaluate": checks.industrial_protocol,
        "rationale": "Seen: at least one frame of such a protocol, be it a read. The device answers whatever reaches its port, so only the network decides who may ask.",
        "remediation": "Write down the pairs of hosts that need such sessions, allow those alone, and raise an alarm for any new pair.",
    },
}

_OWN = {"clause_title_source": "own", "verified": False}
_UNCHECKED = "Number and summary come from memory of the subject, not from a copy; look them up before citing them."


def _entry(standard: str, edition: str, clause: str, title: str, summary: str) -> dict:
    return {"standard": standard, "edition": edition, "clause": clause, "clause_title": title, "paraphrase": summary, "verification_note": _UNCHECKED, **_OWN}


CATALOGUE = [
    _entry("IEC-62443-3-3", "2013", "SR 1.1", "Human users", "Each person has an own account, and access to the control system needs it."),
    _entry("IEC-62443-3-3", "2013", "SR 1.2", "Software and devices as users", "Programs and devices have identities too, and are asked for them where they connect."),
    _entry("IEC-62443-3-3", "2013", "SR 4.1", "Secrecy of stored and sent data", "Data that must stay secret is encrypted or kept where nobody else can look."),
    _entry("CLC/TS 50701", "2023", "undetermined-1", "Protection of signalling functions", "Signals and points do what the interlocking says, whoever is on the network."),
    _entry("CLC/TS 50701", "2023", "undetermined-2", "Protection of railway data links", "Data on the links of a railway stays with sender and receiver."),
]
