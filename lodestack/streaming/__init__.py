"""Jobs that run in steps, can be resumed, and tell how far they came."""
