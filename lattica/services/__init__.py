"""Two worked domains on top of a session: code dependencies and a professional network."""
