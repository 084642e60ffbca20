"""Tables in and out: texts, settings, gold lists, replies, results."""
