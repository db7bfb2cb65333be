"""The second look at candidates by a language model: requests, transports, and what becomes of the answers."""
