"""Part of slotwise."""
