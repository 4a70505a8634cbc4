"""Texts that have a scheduler of the machine start runs: twice a day at the sessions' minute, and hourly to catch up."""

from __future__ import annotations

import shlex
from collections.abc import Sequence
from xml.sax.saxutils import escape

#: Local times of the sessions, and the minute at which a missed one is caught up.
SESSIONS, CATCH_UP_MINUTE = ((7, 17), (19, 17)), 47


def crontab(command: Sequence[str], zone: str = "America/Los_Angeles", catch_up: bool = True) -> str:
    """Lines for crontab; a run that is not due ends at once, so catching up does no harm."""
    text = " ".join(map(shlex.quote, command)).replace("%", r"\%")
    lines = [f"CRON_TZ={zone}", *(f"{minute} {hour} * * * {text}" for hour, minute in SESSIONS)]
    return "\n".join(lines + ([f"{CATCH_UP_MINUTE} * * * * {text}"] if catch_up else [])) + "\n"


def launchd(label: str, command: Sequence[str], folder: str, log: str) -> str:
    """A property list for launchd."""
    s = lambda v: f"<string>{escape(str(v))}</string>"
    times = "".join(f"<dict><key>Hour</key><integer>{h}</integer><key>Minute</key><integer>{m}</integer></dict>" for h, m in SESSIONS)
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE plist PUBLIC "-//Apple//DTD PLIST 1.0//EN" "http://www.apple.com/DTDs/PropertyList-1.0.dtd">\n<plist version="1.0"><dict>'
        f"<key>Label</key>{s(label)}<key>ProgramArguments</key><array>{''.join(map(s, command))}</array><key>WorkingDirectory</key>{s(folder)}"
        f"<key>StartCalendarInterval</key><array>{times}</array><key>StandardOutPath</key>{s(log)}<key>StandardErrorPath</key>{s(log)}</dict></plist>\n"
    )
