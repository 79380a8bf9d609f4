"""Record streams, collectors and updates."""
