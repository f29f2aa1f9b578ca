"""Known log formats."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LogFormat:
    """``pattern`` finds one record within a line. A column in ``optional`` stays NULL
    when the group that holds it took no part in the match."""

    pattern: str
    columns: tuple[str, ...]
    optional: dict[str, str]


# Record patterns and their columns, in order of preference.
LOG_FORMATS = {
    "apache_combined": LogFormat(
        r'(?<ip>\S+)\s+\S+\s+\S+\s+\[(?<timestamp>[^\]]+)\]\s+'
        r'"(?<method>\S+)\s+(?<endpoint>\S+)\s+\S+"\s+(?<status>\d{3})\s+(?<size>\S+)'
        r'(?<tail>\s+"(?<referrer>[^"]*)"\s+"(?<useragent>[^"]*)")?',
        ("ip", "timestamp", "method", "endpoint", "status", "size", "referrer", "user_agent"),
        {"referrer": "tail", "user_agent": "tail"},
    ),
    "nginx_access": LogFormat(
        r'(?<ip>\S+)\s+-\s+-\s+\[(?<timestamp>[^\]]+)\]\s+'
        r'"(?<method>\S+)\s+(?<endpoint>\S+)\s+\S+"\s+(?<status>\d{3})\s+(?<size>\d+)\s+'
        r'"(?<referrer>[^"]*)"\s+"(?<useragent>[^"]*)"',
        ("ip", "timestamp", "method", "endpoint", "status", "size", "referrer", "user_agent"),
        {},
    ),
    "apache_csv": LogFormat(
        r'(?<ip>[a-fA-F0-9.:]+),-,-,\[(?<timestamp>[^\]]+)\],"(?<method>\w+)",'
        r'(?<endpoint>[^,]+),[^,]+,(?<status>\d{3}),(?<size>[\d\-]+),[^,]+,"(?<agent>[^"]+)',
        ("ip", "timestamp", "method", "endpoint", "status", "size", "agent"),
        {},
    ),
    "syslog": LogFormat(
        r"(?<timestamp>\w+\s+\d+\s+\d+:\d+:\d+)\s+(?<hostname>\S+)\s+"
        r"(?<service>\S+?)(?<tail>\[(?<pid>\d+)\])?:\s+(?<message>.+)",
        ("timestamp", "hostname", "service", "pid", "message"),
        {"pid": "tail"},
    ),
}
