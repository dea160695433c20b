"""SQL entry, literal bounds, plan inspection."""
